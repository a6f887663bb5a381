"""Context-triggered piecewise hashing of whole texts, and the likeness of two fingerprints.

A rolling hash of the last seven bytes ends a chunk wherever it hits the trigger of the block size; each chunk
adds one of 64 signature letters.  The block size is 3 * 2**k, chosen so that the signature holds at most 64 letters,
and a second signature is made at twice that size.  Two fingerprints are compared by edit distance where they have
a block size in common.

Defined results: null counts as the empty text; equal texts have equal fingerprints and likeness 1; fingerprints
without a common block size have likeness 0, as has an empty text against any other; documents follow each other
by descending doc_id, then text (rows that repeat a doc_id are neighbours; null ids last); a single document is
its own next one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import pieces, seeds

SPAN = 7
LETTERS = 64
LEAST = 3
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_PIECE = 1 << 20
#: Rows that a task holds as Python strings at once, and fingerprints that it remembers.
_ROWS = 128
_KNOWN = 20_000
_MULTIPLY = (seeds(SPAN, 21) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_VALUE = (seeds(256, 22) >> np.uint64(32)).astype(np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the ``SPAN`` bytes up to each byte (fewer at the start)."""
    value = _VALUE[data]
    out = value * _MULTIPLY[0]
    for back in range(1, min(SPAN, len(value))):
        out[back:] += value[:-back] * _MULTIPLY[back]
    out ^= out >> np.uint32(15)
    return out


def _triggers(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks end at block sizes ``LEAST * 2**size`` and up: positions and the largest exponent each ends.

    A position ends a chunk at block size 3 * 2**k if its hash is a multiple of 3 and then of 2**k.
    """
    at, power = [], []
    for low in range(0, len(data), _PIECE):
        h = rolling(data[max(low - SPAN + 1, 0) : low + _PIECE])[min(low, SPAN - 1) :]
        quotient = h // np.uint32(LEAST)
        hit = np.flatnonzero((quotient * np.uint32(LEAST) == h) & (quotient & np.uint32((1 << size) - 1) == 0))
        q = quotient[hit].astype(np.int64) | (1 << 31)
        at.append(hit + low)
        power.append(np.log2((q & -q).astype(np.float64)).astype(np.int64))
    return np.concatenate(at), np.concatenate(power)


def _signature(data: memoryview, ends: np.ndarray) -> str:
    """One letter for each chunk: the last chunk takes all that is left."""
    out, start = [], 0
    for end in (*(ends[: LETTERS - 1] + 1).tolist(), len(data)):
        if end > start:
            out.append(ALPHABET[zlib.crc32(data[start:end]) & 63])
        start = end
    return "".join(out)


def fingerprint(raw: bytes) -> str:
    """``block size:signature:signature at twice the size``."""
    if not raw:
        return f"{LEAST}::"
    data = np.frombuffer(raw, np.uint8)
    size = max(0, int(np.ceil(np.log2(max(len(raw) / (LEAST * LETTERS), 1)))))
    guess = size
    at, power = _triggers(data, max(guess - 6, 0))
    while size and (power >= size).sum() < LETTERS // 2:
        size -= 1
    if size < max(guess - 6, 0):
        at, power = _triggers(data, size)
    view = memoryview(raw)
    return f"{LEAST << size}:{_signature(view, at[power >= size])}:{_signature(view, at[power > size])}"


# ---- likeness ---------------------------------------------------------------------------------------------------

_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(64)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), LETTERS), 64, np.int64)
    out[np.arange(LETTERS)[None, :] < sizes[:, None]] = _CODE[np.frombuffer("".join(texts).encode(), np.uint8)]
    return out, sizes


def edit_distances(left: list[str], right: list[str]) -> np.ndarray:
    """Levenshtein distances of pairs of signatures, all pairs at once: each column of the table is one 64-bit word."""
    n = len(left)
    a, size_a = _codes(left)
    b, size_b = _codes(right)
    where = np.zeros((n, 65), np.uint64)
    rows = np.arange(n)
    for i in range(LETTERS):
        where[rows, a[:, i]] |= np.where(i < size_a, np.uint64(1 << i), np.uint64(0))
    where[:, 64] = 0
    one = np.uint64(1)
    up, down = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    distance, last = size_a.copy(), np.where(size_a > 0, one << np.maximum(size_a - 1, 0).astype(np.uint64), np.uint64(0))
    for j in range(int(size_b.max(initial=0))):
        live = j < size_b
        match = where[rows, b[:, j]]
        diagonal = (((match & up) + up) ^ up) | match | down
        grow, shrink = down | ~(diagonal | up), up & diagonal
        distance += (live & ((grow & last) > 0)).astype(np.int64) - (live & ((shrink & last) > 0))
        grow, shrink = (grow << one) | one, shrink << one
        up = np.where(live, shrink | ~(diagonal | grow), up)
        down = np.where(live, grow & diagonal, down)
    return np.where(size_a == 0, size_b, distance)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """0 to 1 for pairs of fingerprints: the best of the signatures at a block size they share."""
    out = np.zeros(len(left))
    pairs: tuple[list[int], list[str], list[str]] = ([], [], [])
    for i, (x, y) in enumerate(zip(left, right)):
        if x == y:
            out[i] = 1.0
            continue
        (p, p1, p2), (q, q1, q2) = x.split(":"), y.split(":")
        p, q = int(p), int(q)
        for size_x, sign_x in ((p, p1), (2 * p, p2)):
            for size_y, sign_y in ((q, q1), (2 * q, q2)):
                if size_x == size_y and sign_x and sign_y:
                    for to, value in zip(pairs, (i, sign_x, sign_y)):
                        to.append(value)
    if pairs[0]:
        longest = np.maximum([len(s) for s in pairs[1]], [len(s) for s in pairs[2]])
        np.maximum.at(out, pairs[0], 1 - edit_distances(pairs[1], pairs[2]) / longest)
    return out


# ---- documents and their neighbours ------------------------------------------------------------------------------


def compare_with_edits(documents: DataFrame, rows_per_range: int = 4000) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and likeness to the edit and to the next document.

    Texts move once, to ranges of descending doc_id, a task for each; the first document of a range also goes to the
    range before it, whose last document needs it.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.count()
    if not total:
        return spark.createDataFrame([], _OUT)
    ranges = max(1, -(-total // rows_per_range))
    order = F.coalesce(-F.col("doc_id"), F.lit((1 << 63) - 1))  # ascending: largest id first, null last
    cuts = _cuts(docs.select(order.alias("key")), ranges)
    placed = docs.withColumn("key", order).withColumn("range", _range_of(cuts))
    heads = {r["range"]: r["key"] for r in placed.groupBy("range").agg(F.min("key").alias("key")).collect()}  # a row per range
    order_of = sorted(heads)
    before = {r: order_of[i - 1] for i, r in enumerate(order_of)}  # the first range follows the last
    guests = _deal(placed, heads, before)
    out = guests.repartitionById(ranges, F.col("range").cast("int")).sortWithinPartitions("range", "guest", "key", "text").select("range", "guest", "doc_id", "text")
    return out.mapInArrow(_neighbours, _OUT)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _cuts(keys: DataFrame, ranges: int) -> list[int]:
    """The largest key of each range but the last; only ids move, and one row per range reaches the driver."""
    dealt = keys.repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.max("key").alias("key"))
    return sorted(r["key"] for r in dealt.collect())[:-1]


def _range_of(cuts: list[int]):
    @F.pandas_udf("long")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts, np.int64), keys.to_numpy(np.int64), "left"))

    return place(F.col("key"))


def _deal(placed: DataFrame, heads: dict[int, int], before: dict[int, int]) -> DataFrame:
    """All rows in their ranges, and the first rows of each range once more as guests of the range before."""
    spark = placed.sparkSession
    first = spark.createDataFrame([(r, k, before[r]) for r, k in heads.items()], "range long, head long, home long")
    joined = placed.join(F.broadcast(first), "range")
    return joined.select(
        F.explode(
            F.when(F.col("key") == F.col("head"), F.array(F.struct("range", F.lit(False).alias("guest")), F.struct(F.col("home").alias("range"), F.lit(True).alias("guest"))))
            .otherwise(F.array(F.struct("range", F.lit(False).alias("guest"))))
        ).alias("to"),
        "key", "doc_id", "text",
    ).select("to.range", "to.guest", "key", "doc_id", "text")


def _neighbours(batches):
    """Rows come by range, own rows in order and then guests; each row is answered once its next one is known."""
    waiting, current, met_guest = None, None, False
    known: dict[bytes, str] = {}
    for batch in pieces(batches, _ROWS):
        done: list[tuple] = []
        for place, guest, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if place != current:
                waiting, current, met_guest = None, place, False
            if guest and met_guest:
                continue  # only the first guest follows the last row
            if waiting is not None:
                done.append((*waiting, text))
            waiting, met_guest = (doc, text), guest
            if guest:
                waiting = None
        if done:
            yield _answers(done, known)


def _answers(rows: list[tuple], known: dict[bytes, str]) -> pa.RecordBatch:
    """``known`` holds fingerprints by digest, never texts."""
    if len(known) > _KNOWN:
        known.clear()

    def of(raw: bytes, digest: bytes) -> str:
        if digest not in known:
            known[digest] = fingerprint(raw)
        return known[digest]

    def of_text(text: str) -> str:
        raw = text.encode("utf-8", "replace")
        return of(raw, hashlib.sha256(raw).digest())

    own, edited, following, hashes = [], [], [], []
    for place, (_, text, after) in enumerate(rows):
        n = len(text) // 3
        changed = text[: len(text) - n] + after[:n]
        raw = changed.encode("utf-8", "replace")
        digest = hashlib.sha256(raw).digest()
        own.append(following[-1] if place and text is rows[place - 1][2] else of_text(text))
        following.append(of_text(after))
        edited.append(of(raw, digest))
        hashes.append(digest.hex())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array(hashes, pa.string()), pa.array(own, pa.string()),
            pa.array(edited, pa.string()), pa.array(likeness(own, edited), pa.float64()), pa.array(likeness(own, following), pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
