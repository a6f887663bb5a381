"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

A document becomes a bag of hashed features: its words, and for each word its form (ending, length, share of capitals and
of punctuation), and how often it repeats itself.  Weighted by inverse document frequency and scaled to length 1, the bags
of a bounded labelled sample (``max_rows`` per label) give a truncated singular value decomposition; its right
singular vectors carry any document into ``dims`` dimensions.  The labelled vectors (at most 2 * ``max_rows`` rows of
``dims`` floats) are broadcast, the cosine of every document with every one of them is computed in blocks, and the ``k``
nearest vote with weights that grow with similarity.

Defined results: a document without any feature (null, empty or blank) gets the share of label 1; without labelled rows the score
is 0.5; of conflicting labels of an id the larger counts; ties among neighbours go to the smaller id; rows that repeat
an id are scored each; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.samples import one_label, sample_rows
from tidemark.llm.words import NOT_SPACE, edge_hashes, flat, mix, pieces, spans

BITS = 12
MAX_ROWS = 4000
DIMS = 64
NEIGHBOURS = 25
POWER = 8.0
BLOCK = 512
_UPPER = np.zeros(256, np.int64)
_UPPER[ord("A") : ord("Z") + 1] = 1
_MARKS = np.zeros(256, np.int64)
_MARKS[list(range(0x21, 0x30)) + list(range(0x3A, 0x41)) + list(range(0x5B, 0x61)) + list(range(0x7B, 0x7F))] = 1


def _within(flags: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags[data])])
    return total[start + size] - total[start]


def bags(column: pa.Array) -> np.ndarray:
    """Counts of hashed features, one dense row of ``2 ** BITS`` per text."""
    rows = len(column)
    data, offsets = flat(column)
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets - base
    hashes, start, size, first = spans(data, offsets, NOT_SPACE)
    of = np.repeat(np.arange(rows), np.diff(first))
    if not len(of):
        return np.zeros((rows, 1 << BITS), np.float32)
    upper, marks = _within(_UPPER, data, start, size), _within(_MARKS, data, start, size)
    form = np.minimum(size, 15) + 16 * np.minimum(marks, 3) + 64 * np.where(upper == 0, 0, np.where(upper == 1, 1, np.where(upper + marks >= size, 3, 2)))
    kinds = [hashes, edge_hashes(data, start, size, 2, end=True), mix(form.astype(np.uint64) + np.uint64(1 << 40))]
    # the share of words that the text has had before, in eighths, counted as often as there are words
    both = np.unique(of.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    words = np.diff(first)
    new = np.bincount((both >> np.uint64(40)).astype(np.int64), minlength=rows)
    eighth = 8 * (words - new) // np.maximum(words, 1)
    extra = mix((eighth + 100 * np.minimum(np.bitwise_count(words.astype(np.uint64)) * 0 + np.log2(words + 1).astype(np.int64), 12)).astype(np.uint64) + np.uint64(1 << 41))
    number = np.concatenate([(k >> np.uint64(64 - BITS)).astype(np.int64) for k in kinds])
    out = np.bincount(np.concatenate([of, of, of]) << BITS | number, minlength=rows << BITS).reshape(rows, 1 << BITS).astype(np.float32)
    out[np.arange(rows), (mix(eighth.astype(np.uint64) + np.uint64(1 << 42)) >> np.uint64(64 - BITS)).astype(np.int64)] += words
    out[np.arange(rows), (extra >> np.uint64(64 - BITS)).astype(np.int64)] += words / 2
    return out


@dataclass
class Model:
    """Feature weights, projection, labelled vectors and their labels."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = np.sqrt(counts) * self.weights
        x = x @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, column: pa.Array, k: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(column), 0.5)
        out = np.empty(len(column))
        for low in range(0, len(column), BLOCK):
            counts = bags(column.slice(low, BLOCK))
            cosine = self.project(counts) @ self.vectors.T
            k = min(k, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** POWER
            total = weight.sum(1)
            vote = (weight * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
            out[low : low + len(vote)] = np.where((total > 0) & (counts.sum(1) > 0), vote, self.labels.mean())
        return np.clip(out, 0, 1)


def fit(counts: np.ndarray, labels: np.ndarray, dims: int = DIMS, rounds: int = 4, seed: int = 7) -> Model:
    """Weights and the truncated decomposition (by subspace iteration) of the labelled bags."""
    n = len(counts)
    idf = np.log((1 + n) / (1 + (counts > 0).sum(0))).astype(np.float32) + 0.1
    x = np.sqrt(counts) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    dims = min(dims, n, x.shape[1])
    basis = np.random.default_rng(seed).standard_normal((x.shape[1], min(dims + 16, n, x.shape[1]))).astype(np.float32)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, rotate = np.linalg.svd(x @ basis, full_matrices=False)
    axes = np.ascontiguousarray(basis @ rotate[:dims].T)
    model = Model(idf, axes, np.empty((0, dims), np.float32), labels.astype(np.float64))
    model.vectors = model.project(counts)
    return model


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, dims: int = DIMS, seed: int = 7) -> Model:
    """Learn from ``labels`` (``doc_id, quality``) of ``documents``; the ids of the sample, bounded by ``max_rows``, are broadcast."""
    marked = sample_rows(one_label(labels, "doc_id", "quality"), "id", max_rows, "label", seed)
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marked), "id").select("id", "label", "text")

    def read(batches):
        for batch in pieces(batches, 256):
            counts = bags(batch.column(2))
            row, number = np.nonzero(counts)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (number.astype(np.int32), counts[row, number])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["id", "label", "numbers", "counts"])

    table = rows.mapInArrow(read, "id long, label int, numbers array<int>, counts array<float>").toArrow().sort_by("id")
    if not len(table):
        return Model(np.ones(1 << BITS, np.float32), np.empty((1 << BITS, 0), np.float32), np.empty((0, 0), np.float32), np.empty(0))
    numbers = table["numbers"].combine_chunks()
    row = np.repeat(np.arange(len(table)), np.diff(numbers.offsets.to_numpy()))
    counts = np.zeros((len(table), 1 << BITS), np.float32)
    counts[row, numbers.flatten().to_numpy()] = table["counts"].combine_chunks().flatten().to_numpy()
    return fit(counts, table["label"].to_numpy(), dims, seed=seed)


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row."""
    sent = documents.sparkSession.sparkContext.broadcast((model.weights, model.axes, model.vectors, model.labels))

    def judge(batches):
        own = Model(*sent.value)
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(batch.column(1)))], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(judge, "doc_id long, score double")
