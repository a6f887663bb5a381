"""Centroid clustering of vectors in exact integers, pruned by Ptolemaic pivots.

For any points o, c and pivots p, s of a Euclidean space Ptolemy's inequality gives
``d(o, c) * d(p, s) >= |d(o, p) * d(c, s) - d(o, s) * d(c, p)|``.  The distances from each vector to a few fixed pivots
are computed once and stored beside it; each round then needs only those of the (few) centroids.  The best bound over
fixed pairs of pivots rules centroids out; bounds are rounded down by more than their floating-point error, so no
centroid that could be nearest (or tie) is ever ruled out.  The centroid of the least bound is measured exactly, and so
is every other whose bound does not exceed that distance.

Spark holds the vectors; each round is one pass in which a task adds up its own members, and one row per centroid
reaches the driver.  Nothing is cached in executors: the prepared table lies in the shared folder.

Defined results: vectors that are null, of another length, or hold a null or non-finite component are out.  Rows that
repeat an id are vectors of their own; starting vectors tie by component, rows without id come last.  With fewer
vectors than clusters each is a start of its own.  An empty table gives no rows.  A component of 2 ** 17 or more
(2 ** 27 after scaling, where squared distances no longer fit their type) ends the job with an error that says so.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import stage

PIVOTS = 8
#: Relative error allowed for in a bound; that of the arithmetic below is under 16 units of 2 ** -53.
SLACK = 1e-14
LIMIT = 1 << 27
BLOCK = 4096


@dataclass(frozen=True)
class Pivots:
    points: np.ndarray  # pivots x dims
    pairs: tuple[tuple[int, int], ...]
    gaps: np.ndarray  # distance of the two pivots of each pair

    @staticmethod
    def of(points: np.ndarray) -> "Pivots":
        """All pairs of different pivots."""
        pairs = [(i, j) for i, j in itertools.combinations(range(len(points)), 2) if (points[i] != points[j]).any()]
        gaps = np.array([np.sqrt(float(_squared(points[i : i + 1], points[j])[0])) for i, j in pairs])
        return Pivots(points, tuple(pairs), gaps)

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.stack([_squared(vectors, p) for p in self.points], axis=1).astype(float))

    def bounds(self, near: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Lower bounds of the distance of each vector (rows, given by its pivot distances) to each centroid."""
        out, far = np.zeros((len(near), len(centroids))), self.distances(centroids)
        for (p, s), gap in zip(self.pairs, self.gaps):
            a, b = np.outer(near[:, p], far[:, s]), np.outer(near[:, s], far[:, p])
            np.maximum(out, (np.abs(a - b) - SLACK * (a + b)) / (gap * (1 + SLACK)), out=out)
        return out * (1 - SLACK)


def _squared(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    gap = vectors - point
    return np.einsum("ij,ij->i", gap, gap)


def nearest(vectors: np.ndarray, near: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector (ties: the smaller number), its squared distance, and how many were measured."""
    rows = np.arange(len(vectors))
    low = pivots.bounds(near, centroids)
    first = low.argmin(axis=1)
    best = centroids[first] - vectors
    best = np.einsum("ij,ij->i", best, best)
    measured = np.full((len(vectors), len(centroids)), np.iinfo(np.int64).max)
    measured[rows, first] = best
    survives = low * low * (1 - SLACK) <= best[:, None] * (1 + SLACK)
    survives[rows, first] = False
    for k in range(len(centroids)):
        at = np.flatnonzero(survives[:, k])
        measured[at, k] = _squared(vectors[at], centroids[k])
    chosen = measured.argmin(axis=1)
    return chosen, measured[rows, chosen], len(rows) + int(survives.sum())


# vectors as rows of bytes ----------------------------------------------------------------


def _blocks(batches, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of the prepared table with its vectors and their pivot distances as arrays."""
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK):
            part = batch.slice(low, BLOCK)
            yield part, _rows(part.column("vector"), np.int32, dims).astype(np.int64), _rows(part.column("near"), np.float64, None)


def _rows(column: pa.Array, kind, width: int | None) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind).reshape(len(column), width if width else -1)


def _usable(dims: int, column: str):
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.isNotNull() & (F.size(c) == dims) & finite


def prepare(vectors: DataFrame, dims: int, scale: int, id_column: str, column: str, salt: str) -> DataFrame:
    """Kept vectors as integer components in bytes, with the hash that orders starting vectors."""
    kept = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x")).where(_usable(dims, "x"))
    rank = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(scale * batch.column("x").flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, dims)
            if (np.abs(x) >= LIMIT).any():
                raise ValueError(f"a vector component is too large: beyond {LIMIT // scale}, squared distances do not fit 64 bits")
            raw = x.astype("<i4").tobytes()
            offsets = pa.py_buffer(np.arange(0, len(raw) + 1, 4 * dims, dtype=np.int32).tobytes())
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("rank"), packed], ["vec_id", "rank", "vector"])

    return kept.select("vec_id", rank.alias("rank"), "x").mapInArrow(pack, "vec_id long, rank string, vector binary")


def _first(prepared: DataFrame, n: int, dims: int) -> np.ndarray:
    """The ``n`` vectors of least hash (rows without id last), tied by components."""
    rows = prepared.orderBy(F.col("rank").isNull(), "rank", "vector").limit(n).collect()
    return np.array([np.frombuffer(bytes(r["vector"]), "<i4") for r in rows], np.int64).reshape(-1, dims)


def _with_pivots(prepared: DataFrame, pivots: Pivots, dims: int) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                near = pivots.distances(_rows(part.column("vector"), np.int32, dims).astype(np.int64)).tobytes()
                step = 8 * len(pivots.points)
                offsets = pa.py_buffer(np.arange(0, len(near) + 1, step, dtype=np.int32).tobytes())
                made = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, offsets, pa.py_buffer(near)])
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("vector"), made], ["vec_id", "vector", "near"])

    return prepared.select("vec_id", "vector").mapInArrow(measure, "vec_id long, vector binary, near binary")


def _totals(table: DataFrame, centroids: np.ndarray, pivots: Pivots) -> dict[int, tuple[int, list[int]]]:
    """Members and componentwise sums of each non-empty cluster, by one pass; a task sends a row per cluster."""
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x, near in _blocks(batches, dims):
            chosen = nearest(x, near, centroids, pivots)[0]
            counts += np.bincount(chosen, minlength=k)
            for c in range(k):
                sums[c] += x[chosen == c].sum(axis=0)
        has = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(counts[has], pa.int64()), pa.array(sums[has].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = table.mapInArrow(add, "cluster int, n long, sums array<long>")
    wide = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    rows = parts.groupBy("cluster").agg(F.sum(F.col("n")).alias("n"), *wide).collect()
    return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) for i in range(dims)]) for r in rows}


def _hex(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    scale: int = 1024,
    id_column: str = "vec_id",
    column: str = "embedding",
    salt: str = "3:",
) -> DataFrame:
    """Cluster, squared distance and centroid digest of every usable vector, with the totals of both distances."""
    spark = vectors.sparkSession
    prepared = stage(prepare(vectors, dims, scale, id_column, column, salt), "vectors")
    points = _first(prepared, max(k, PIVOTS), dims)
    if not len(points):
        return spark.createDataFrame([], OUTPUT)
    centroids, pivots = points[:k].copy(), Pivots.of(points[:PIVOTS])
    table = stage(_with_pivots(prepared, pivots, dims), "pivots")
    for _ in range(rounds):
        for c, (n, sums) in _totals(table, centroids, pivots).items():
            centroids[c] = [s // n for s in sums]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, near in _blocks(batches, dims):
            chosen, far, _ = nearest(x, near, centroids, pivots)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(chosen.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    assigned = stage(table.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    total = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    of = F.array(*(F.lit(total.get(c, 0)).cast("long") for c in range(len(centroids))))
    names = F.array(*(F.lit(_hex(c)) for c in centroids))
    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        of[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(total.values())).cast("long").alias("inertia"),
        names[F.col("cluster")].alias("centroid_sha256"),
    )


OUTPUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
