"""Toxicity from confirmed toxic examples and unlabelled text: non-negative positive-unlabelled learning.

A document is the set of its words and of its word beginnings (four to six bytes), hashed, each
once for occurring, once for occurring twice and once for three times or more.  Features are
chosen one by one: each time the one whose share among the toxic examples exceeds that in unlabelled text most surely (a
likelihood ratio), counted over the documents that do not yet hold ``COVER`` chosen ones, so that words which
merely go along with toxic ones stay out.  The chosen ones enter linear classifiers.  They
minimise the class-prior-corrected risk ``p * R_P(+) + max(0, R_U(-) - p * R_P(-))`` with logistic loss; where the bracket
turns negative the step goes the other way, so that the classifiers cannot fit unlabelled text as all negative.  The
class prior is the share of toxic rows among the labelled ones (a parameter where only toxic rows are known).  The
score is the mean of ``BAGS`` classifiers trained on different halves of the unlabelled text.

Fitting uses bounded samples (at most ``max_positive`` and ``max_unlabelled`` distinct rows); their features are counted in
Spark, and only those that could be chosen reach the driver.  Scoring takes whole texts.

Defined results: null and empty texts get the score of a document without features; without any toxic example
the score is 0; of conflicting labels of an id the larger counts; of rows that
repeat an id each distinct text may be learnt from, once; they are scored each; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.samples import distinct_texts, one_label, sample_rows
from tidemark.llm.tables import stage
from tidemark.llm.words import LETTERS, edge_hashes, flat, pieces, spans

BITS = 32
BEGINNINGS = (4, 5, 6)
MAX_POSITIVE = 3000
MAX_UNLABELLED = 6000
MAX_FEATURES = 1024
MIN_RATIO = 15.0
COVER = 5
LEVELS = 3
BAGS = 3
PRIOR = 0.1
SCORED_AT_ONCE = 1024


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words and word beginnings, and the row each belongs to (with repeats)."""
    data, offsets = flat(column)
    hashes, start, size, first = spans(data, offsets, LETTERS)
    of = np.repeat(np.arange(len(column)), np.diff(first))
    numbers, rows = [hashes], [of]
    for n in BEGINNINGS:
        long = size >= n
        numbers.append(edge_hashes(data, start[long], size[long], n))
        rows.append(of[long])
    return (np.concatenate(numbers) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(rows)


def _distinct(number: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature once per row for being there, once more for being there twice, and for three times or more."""
    both, times = np.unique(of << BITS | number, return_counts=True)
    number, of = both & ((1 << BITS) - 1), both >> BITS
    levels = [(number[times > i] << 2 | i, of[times > i]) for i in range(LEVELS)]
    number, of = (np.concatenate(x) for x in zip(*levels))
    order = np.argsort(of, kind="stable")
    return number[order], of[order]


def _featured(rows: DataFrame) -> DataFrame:
    """Distinct features of the sampled rows (``role, text``)."""

    def read(batches):
        for batch in pieces(batches, 512):
            number, of = _distinct(*features(batch.column(1)))
            ends = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(number))], ["role", "features"])

    return rows.mapInArrow(read, "role int, features array<long>")


def _likely(rows: DataFrame) -> np.ndarray:
    """The features that a choice could take, sorted; counted in Spark.

    They occur in two toxic rows or more, and more surely there than elsewhere (by a little less than ``MIN_RATIO``, which
    ``choose`` asks for again).
    """
    sizes = {r["role"]: r["count"] for r in rows.groupBy("role").count().collect()}
    n, m = (F.lit(float(max(sizes.get(role, 0), 1))) for role in (1, 0))
    counts = rows.select("role", F.explode("features").alias("f")).groupBy("f").agg(
        F.sum("role").cast("double").alias("a"), F.sum(1 - F.col("role")).cast("double").alias("b")
    )
    share = F.least(F.greatest((F.col("a") + F.col("b")) / (n + m), F.lit(1e-12)), F.lit(1 - 1e-12))

    def side(k, size):
        held = F.when(k > 0, k * F.log(k / size / share)).otherwise(0.0)
        return held + F.when(k < size, (size - k) * F.log((1 - k / size) / (1 - share))).otherwise(0.0)

    a, b = F.col("a"), F.col("b")
    found = counts.where((a >= 2) & (a * m > b * n) & (2 * (side(a, n) + side(b, m)) >= MIN_RATIO - 0.01)).select("f").toArrow()
    return np.sort(found["f"].to_numpy())


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the sampled rows, role, likely features, and first feature per row: all that reaches the driver."""
    rows = stage(_featured(rows), "features")
    likely = _likely(rows)

    def keep(batches):
        for batch in batches:
            lists = batch.column(1)
            number = lists.flatten().to_numpy()
            kept = _held(likely, number)
            ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(number[kept]))], ["role", "features"])

    table = rows.mapInArrow(keep, "role int, features array<long>").toArrow()
    lists = table["features"].combine_chunks()
    return table["role"].to_numpy(), lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])


def _held(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a sorted table holds."""
    if not len(table):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


@dataclass
class Model:
    """Weight per feature and bias of each classifier; none if there was nothing to learn from."""

    numbers: np.ndarray
    weights: np.ndarray
    biases: np.ndarray

    def logits(self, number: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
        bases = np.unique(self.numbers >> 2)
        number, of = _distinct(*(x[_held(bases, number)] for x in (number, of)))
        known = _held(self.numbers, number)
        number, of = number[known], of[known]
        at = np.searchsorted(self.numbers, number)
        return np.stack([np.bincount(of, w[at], rows) + b for w, b in zip(self.weights, self.biases)])

    def score(self, column: pa.Array) -> np.ndarray:
        if not len(self.biases):
            return np.zeros(len(column))
        return (1 / (1 + np.exp(-self.logits(*features(column), len(column))))).mean(0)


def _ratio(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Likelihood ratio statistic of ``a`` of ``n`` against ``b`` of ``m``."""

    def side(k, size, share):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(np.where(k > 0, k / size / share, 1)), 0) + np.where(k < size, (size - k) * np.log(np.where(k < size, (1 - k / size) / (1 - share), 1)), 0)

    share = np.clip((a + b) / (n + m), 1e-12, 1 - 1e-12)
    return 2 * (side(a, n, share) + side(b, m, share))


def nnpu(positive, unlabelled, width: int, prior: float, steps: int = 300, rate: float = 0.1, penalty: float = 1e-4, slack: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias; ``positive`` and ``unlabelled`` are (features, first feature per row) with features below ``width``."""
    sides = []
    for number, first in (positive, unlabelled):
        of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        sides.append((number, of, len(first) - 1))
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    moment, square = np.zeros(width + 1), np.zeros(width + 1)

    def push(side, slope):
        number, of, _ = side
        return np.append(np.bincount(number, slope[of], width), slope.sum())

    for step in range(1, steps + 1):
        p, u = (1 / (1 + np.exp(-np.clip(np.bincount(s[1], w[s[0]], s[2]) + w[-1], -30, 30))) for s in sides)
        n_p, n_u = sides[0][2], sides[1][2]
        negative = -np.log1p(-np.minimum(u, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(p, 1 - 1e-12)).mean()
        grad_negative = push(sides[1], u / n_u) - prior * push(sides[0], p / n_p)
        if negative < -slack:
            grad = -grad_negative
        else:
            grad = prior * push(sides[0], (p - 1) / n_p) + grad_negative
        grad[:-1] += penalty * w[:-1]
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        w -= rate / (1 + step / 100) * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(documents: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
          prior: float | None = None, seed: int = 3) -> Model:
    """Learn from rows of ``labels`` (``doc_id, toxic``) marked toxic and from any rows of ``documents``."""
    marked = one_label(labels, "doc_id", "toxic")
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if not counts.get(1):
        return Model(np.empty(0, np.int64), np.empty((0, 0)), np.empty(0))
    share = prior or (counts[1] / sum(counts.values()) if counts.get(0) else PRIOR)
    share = min(max(share, 1e-3), 0.9)
    toxic = sample_rows(marked.where("label = 1"), "id", max_positive, "label", seed).select("id")
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).withColumn("role", F.lit(0))
    plain = distinct_texts(sample_rows(docs.where("id is not null"), "id", max_unlabelled, "role", seed + 1), max_unlabelled, seed)
    known = distinct_texts(docs.join(F.broadcast(toxic), "id", "left_semi"), max_positive, seed)
    both = known.select(F.lit(1).alias("role"), "text").unionByName(plain.select(F.lit(0).alias("role"), "text"))
    role, number, first = _collected(both)
    return fit(role, number, first, share, seed)


def choose(role: np.ndarray, number: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features (numbers from 0), chosen by what they add to those chosen before."""
    width = int(number.max(initial=-1)) + 1
    size = np.diff(first)
    row = np.repeat(np.arange(len(role)), size)
    toxic = role[row] == 1
    n, total = (np.bincount(number[t], minlength=width) for t in (toxic, ~toxic))
    n_p, n_u = int((role == 1).sum()), int((role == 0).sum())

    def gain(p, u, left_p, left_u):
        return np.where(p * left_u > u * left_p, _ratio(p, max(left_p, 1), u, max(left_u, 1)), 0)

    candidates = np.flatnonzero(n >= 2)
    candidates = candidates[gain(n[candidates], total[candidates], n_p, n_u) >= MIN_RATIO]
    place = np.full(width, -1, np.int64)
    place[candidates] = np.arange(len(candidates))
    kept = place[number] >= 0
    feature, row = place[number[kept]], row[kept]
    by_row = np.searchsorted(row, np.arange(len(role) + 1))
    order = np.argsort(feature, kind="stable")
    by_feature = np.searchsorted(feature[order], np.arange(len(candidates) + 1))
    counts = {r: np.bincount(feature[role[row] == r], minlength=len(candidates)) for r in (0, 1)}
    left, hits, chosen = {0: n_u, 1: n_p}, np.zeros(len(role), np.int64), []
    free = np.ones(len(candidates), bool)
    while len(chosen) < min(MAX_FEATURES, len(candidates)):
        value = np.where(free, gain(counts[1], counts[0], left[1], left[0]), 0)
        best = int(value.argmax())
        if value[best] < MIN_RATIO:
            break
        free[best] = False
        chosen.append(best)
        rows = row[order[by_feature[best] : by_feature[best + 1]]]
        hits[rows] += 1
        for r in rows[hits[rows] == COVER].tolist():
            kind = int(role[r])
            left[kind] -= 1
            counts[kind][feature[by_row[r] : by_row[r + 1]]] -= 1
    return np.sort(candidates[chosen]) if chosen else np.empty(0, np.int64)


def fit(role: np.ndarray, number: np.ndarray, first: np.ndarray, prior: float, seed: int = 3) -> Model:
    """Classifiers from rows with role 1 (toxic) and 0 (unlabelled)."""
    if not (role == 1).any() or not (role == 0).any():
        return Model(np.empty(0, np.int64), np.empty((0, 0)), np.empty(0))
    values, number = np.unique(number, return_inverse=True)
    chosen = choose(role, number, first)
    place = np.full(len(values), -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    row = np.repeat(np.arange(len(role)), np.diff(first))
    kept = place[number] >= 0
    number, row = place[number[kept]], row[kept]

    def side(rows: np.ndarray):
        to = np.full(len(role), -1, np.int64)
        to[rows] = np.arange(len(rows))
        own = to[row] >= 0
        at = np.argsort(to[row[own]], kind="stable")
        return number[own][at], np.concatenate([[0], np.cumsum(np.bincount(to[row[own]], minlength=len(rows)))])

    rng = np.random.default_rng(seed)
    plain, weights, biases = np.flatnonzero(role == 0), [], []
    for _ in range(BAGS):
        half = np.sort(rng.choice(plain, max(1, len(plain) * 2 // 3), replace=False))
        w, b = nnpu(side(np.flatnonzero(role == 1)), side(half), len(chosen), prior)
        weights.append(w)
        biases.append(b)
    return Model(values[chosen], np.array(weights), np.array(biases))


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row."""
    sent = documents.sparkSession.sparkContext.broadcast((model.numbers, model.weights, model.biases))

    def judge(batches):
        own = Model(*sent.value)
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(batch.column(1)))], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(judge, "doc_id long, score double")


def add_score(documents: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """All columns of ``documents`` and the score of the text (an existing column of that name is replaced)."""
    sent = documents.sparkSession.sparkContext.broadcast((model.numbers, model.weights, model.biases))

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        own, column = Model(*sent.value), pa.array(texts, pa.string())
        parts = [own.score(column.slice(low, SCORED_AT_ONCE)) for low in range(0, len(column), SCORED_AT_ONCE)]
        return pd.Series(np.concatenate([np.empty(0), *parts]))

    return documents.withColumn(column, judge(F.col("text").cast("string")))
