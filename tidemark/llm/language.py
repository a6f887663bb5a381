"""Language identification, words first: known words by per-language log frequency, others by character n-grams.

Word and n-gram counts per language are learned from a bounded sample of the labelled rows (``docs_per_language``).  A
word of the table scores its log frequencies.  An unseen word is cut into its character n-grams of five code points, with marks
for its ends; if the table knows none of them, into n-grams of four, and so on down to one; the mean log frequency of
the known ones is its score.  The scores of all words of the whole text add up, and the posterior of the best language
is returned.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every text if there
is nothing to learn from; a text of which nothing is known gets the most frequent language at equal posteriors; ties go to
the first language in order; rows that repeat an id are judged each; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.samples import sample_rows
from tidemark.llm.words import LETTERS, flat, mix, pieces, seeds, spans

ORDERS = (5, 4, 3, 2, 1)
#: Bounds of what is learned from and of what is sent to the tasks (20 bytes an entry and language or so).
DOCS_PER_LANGUAGE = 4000
MAX_WORDS = 400_000
MAX_GRAMS = 200_000
SMOOTHING = 0.1
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLY = seeds(8, 31)


def _grams(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the code point n-grams of ``<word>`` and the word each belongs to."""
    text = "".join(f"\x02{w.decode('utf-8', 'replace')}\x03" for w in words)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(points) < order:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = len(points) - order + 1
    owner = np.cumsum(points == 2) - 1
    out = points[:n] * _MULTIPLY[0]
    for i in range(1, order):
        out += points[i : n + i] * _MULTIPLY[i]
    inside = owner[:n] == owner[order - 1 :]
    if order == 1:  # the marks alone say nothing
        inside &= (points != 2) & (points != 3)
    return mix(out[inside] + np.uint64(order)), owner[:n][inside]


def _distinct_words(data, hashes, start, size) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Distinct hashes, the place of each word among them, and their bytes."""
    value, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    return value, back, [data[s : s + n].tobytes() for s, n in zip(start[at].tolist(), size[at].tolist())]


def _counts(rows: DataFrame) -> DataFrame:
    """``kind`` (0: words, else the n-gram order), ``hash``, ``lang`` and count of the sampled rows (``lang, text``)."""

    def count(batches):
        for batch in pieces(batches, 512):
            data, offsets = flat(pc.utf8_lower(batch.column(1)))
            hashes, start, size, first = spans(data, offsets, LETTERS)
            tongues = np.array(batch.column(0).to_pylist(), object)
            of = np.repeat(np.arange(len(tongues)), np.diff(first))
            for tongue in sorted(set(tongues)):
                own = np.flatnonzero((tongues == tongue)[of])
                if not len(own):
                    continue
                value, back, words = _distinct_words(data, hashes[own], start[own], size[own])
                times = np.bincount(back)
                kinds, keys, counts = [np.zeros(len(value), np.int32)], [value], [times]
                for order in ORDERS:
                    gram, owner = _grams(words, order)
                    g, where = np.unique(gram, return_inverse=True)
                    kinds.append(np.full(len(g), order, np.int32))
                    keys.append(g)
                    counts.append(np.bincount(where, times[owner], len(g)).astype(np.int64))
                kind = np.concatenate(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind), pa.array(np.concatenate(keys).view(np.int64)), pa.array([tongue] * len(kind), pa.string()), pa.array(np.concatenate(counts).astype(np.int64))],
                    ["kind", "hash", "lang", "n"],
                )

    return rows.mapInArrow(count, "kind int, hash long, lang string, n long").groupBy("kind", "hash", "lang").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Languages, and per kind the sorted hashes with their log frequencies per language."""

    languages: list[str]
    common: int
    tables: dict[int, tuple[np.ndarray, np.ndarray]]


def train(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS, seed: int = 5) -> Model:
    """Learn from ``doc_id, text, lang``; rows without text or language are out."""
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = sample_rows(rows.where("text is not null and lang is not null"), "doc_id", docs_per_language, "lang", seed).select("lang", "text")
    counts = _counts(rows).groupBy("kind", "hash").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    kept = None
    for kind, bound in ((0, max_words), *((o, max_grams) for o in ORDERS)):
        part = counts.where((F.col("kind") == kind) & (F.col("total") >= 2)).orderBy(F.desc("total"), "hash").limit(bound)
        kept = part if kept is None else kept.unionByName(part)
    table = kept.select("kind", "hash", F.map_keys("by").alias("langs"), F.map_values("by").alias("ns")).toArrow().combine_chunks()
    langs = table["langs"].combine_chunks() if isinstance(table["langs"], pa.ChunkedArray) else table["langs"]
    ns = table["ns"].combine_chunks() if isinstance(table["ns"], pa.ChunkedArray) else table["ns"]
    names = np.array(langs.flatten().to_pylist(), object)
    languages = sorted(set(names.tolist()))
    row = np.repeat(np.arange(len(table)), np.array(pc.list_value_length(langs).to_pylist(), np.int64))
    dense = np.zeros((len(table), len(languages)))
    if languages:
        dense[row, np.searchsorted(languages, names.astype(str))] = ns.flatten().to_numpy()
    kinds, hashes = table["kind"].to_numpy(), table["hash"].to_numpy().view(np.uint64)
    tables = {}
    for kind in (0, *ORDERS):
        own = np.flatnonzero(kinds == kind)
        own = own[np.argsort(hashes[own])]
        n = dense[own]
        tables[kind] = (hashes[own], np.log((n + SMOOTHING) / (n.sum(0) + SMOOTHING * max(len(own), 1))).astype(np.float32))
    totals = dense[kinds == 0].sum(0)
    return Model(languages, int(totals.argmax()) if len(totals) else 0, tables)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted table, -1 if it is not there."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _unseen(model: Model, words: list[bytes]) -> np.ndarray:
    """Scores of words that the word table does not hold."""
    out = np.zeros((len(words), len(model.languages)), np.float32)
    todo = np.arange(len(words))
    for order in ORDERS:
        if not len(todo):
            break
        table, logs = model.tables[order]
        gram, owner = _grams([words[i] for i in todo.tolist()], order)
        at = _find(table, gram)
        known = at >= 0
        n = np.bincount(owner[known], minlength=len(todo))
        for j in range(out.shape[1]):
            total = np.bincount(owner[known], logs[at[known], j], len(todo))
            out[todo, j] = np.where(n > 0, total / np.maximum(n, 1), 0)
        todo = todo[n == 0]
    return out


def _score(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    has_letter = np.array([t is not None and _LETTER.search(t) is not None for t in column.to_pylist()], bool)
    data, offsets = flat(pc.utf8_lower(column))
    hashes, start, size, first = spans(data, offsets, LETTERS)
    table, logs = model.tables[0]
    at = _find(table, hashes)
    n = len(model.languages)
    sums = np.zeros((len(column), n))
    of = np.repeat(np.arange(len(column)), np.diff(first))
    new = np.flatnonzero(at < 0)
    extra, back = np.zeros((0, n), np.float32), new
    if len(new):
        _, back, words = _distinct_words(data, hashes[new], start[new], size[new])
        extra = _unseen(model, words)
    seen = np.flatnonzero(at >= 0)
    for j in range(n):
        sums[:, j] = np.bincount(of[seen], logs[at[seen], j], len(column)) + np.bincount(of[new], extra[back, j] if len(new) else None, len(column))
    best = np.where((sums == sums[:, :1]).all(1), model.common, sums.argmax(1))
    odds = np.exp(sums - sums.max(1, keepdims=True))
    score = odds[np.arange(len(best)), best] / odds.sum(1)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), has_letter.tolist())], np.where(has_letter, score, 0.0)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row."""
    sent = documents.sparkSession.sparkContext.broadcast((model.languages, model.common, model.tables))

    def guess(batches):
        own = Model(*sent.value)
        for batch in pieces(batches, 1024):
            if own.languages:
                names, score = _score(own, batch.column(1))
            else:
                names, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(guess, "doc_id long, lang_pred string, score double")
