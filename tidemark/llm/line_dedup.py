"""Line deduplication with a sharded minimal perfect hash.

The lines that repeat in enough documents are counted once (partial sums first, so a line that a third of all
documents hold is no hot key), cut into shards by hash, and each shard becomes a minimal perfect hash over its
distinct line hashes that indexes arrays: a 64-bit fingerprint, the number of documents and the last document.
Documents send only line hashes to the shards (16 bytes and the document's id each), which answer from
the arrays; lines are never joined with lines.  A shard that very many lines probe is held by several tasks, each of
which sees a part of the documents.

Defined results: null and empty texts are one empty line; lines shorter than ``min_chars`` code points (after
stripping) are always kept; each row counts as a document, rows that repeat a doc_id too, and the largest doc_id keeps
its lines in all its rows; rows without doc_id count but lose no line; other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.llm.tables import stage
from tidemark.llm.words import mix, seeds

MIN_CHARS = 40
MIN_DOCS = 5
#: Distinct lines in a shard, and probes that one task answers; both bound memory, neither changes a result.
SHARD_LINES = 200_000
TASK_PROBES = 200_000
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


# ---- minimal perfect hash -------------------------------------------------------------------------------------


def build_index(keys: np.ndarray, gamma: float = 1.5, levels: int = 64) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Levels of (slots, bit words, ones before each word) that send distinct 64-bit ``keys`` to 0..n-1 one to one.

    On each level a key whose slot no other key takes is settled there; the others go on to the next level.
    """
    out, rest, before = [], np.asarray(keys, np.uint64), 0
    salts = seeds(levels, 11)
    for level in range(levels):
        if not len(rest):
            break
        slots = max(64, int(len(rest) * gamma))
        at = mix(rest ^ salts[level]) % np.uint64(slots)
        taken = np.bincount(at.astype(np.int64), minlength=slots)
        alone = taken == 1
        bits = np.packbits(alone, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(bits))])[:-1].astype(np.int64) + before
        out.append((slots, bits, ones))
        before += int(alone.sum())
        rest = rest[~alone[at.astype(np.int64)]]
    if len(rest):
        raise ValueError("line hashes are not distinct")
    return out


def look_up(index: list[tuple[int, np.ndarray, np.ndarray]], keys: np.ndarray) -> np.ndarray:
    """The place of each key; keys that were not in the index get any place or -1."""
    keys = np.asarray(keys, np.uint64)
    out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
    salts = seeds(64, 11)
    for level, (slots, bits, ones) in enumerate(index):
        at = (mix(keys[todo] ^ salts[level]) % np.uint64(slots)).astype(np.int64)
        byte, bit = bits[at >> 3], (at & 7).astype(np.uint8)
        found = (byte >> bit & 1).astype(bool)
        below = np.bitwise_count(byte & ((np.uint8(1) << bit) - np.uint8(1)).astype(np.uint8))
        out[todo[found]] = ones[at[found] >> 3] + below[found]
        todo = todo[~found]
    return out


# ---- lines ------------------------------------------------------------------------------------------------------


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _long_lines(text: bytes, min_chars: int) -> list[tuple[int, bytes]]:
    """Position and digest of the lines of at least ``min_chars`` code points."""
    out = []
    for i, line in enumerate(text.lower().split(b"\n")):
        key = line.strip(SPACE)
        if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
            out.append((i, _digest(key)))
    return out


def _bytes(value) -> bytes:
    return (value or "").encode("utf-8", "replace")


def _hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """Distinct long lines of each document as two 64-bit words."""

    def scan(batches):
        for batch in batches:
            digests, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = {d for _, d in _long_lines(_bytes(text), min_chars)}
                digests += own
                rows += [i] * len(own)
            words = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(words[:, 0]), pa.array(words[:, 1])], ["doc_id", "h1", "h2"])

    return docs.mapInArrow(scan, "doc_id long, h1 long, h2 long")


def counted_lines(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``h1, h2, docs, last``: in how many documents each long line is, and in which last."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _hashes(docs, min_chars).groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))


def shard_arrays(repeated: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the index and its arrays as bytes, and the number of probes its own lines will send."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf.h1.to_numpy(np.int64).view(np.uint64)
        index = build_index(keys)
        place = look_up(index, keys)
        arrays = [np.empty(len(keys), np.int64) for _ in range(3)]
        for array, name in zip(arrays, ("h2", "docs", "last")):
            array[place] = pdf[name].fillna(-1 << 63).to_numpy(np.int64)
        return pd.DataFrame(
            {
                "shard": [int(pdf.shard.iloc[0])],
                "slots": [np.array([s for s, _, _ in index], np.int64).tobytes()],
                "bits": [b"".join(b.tobytes() for _, b, _ in index)],
                "prints": [arrays[0].tobytes()],
                "counts": [arrays[1].tobytes()],
                "lasts": [arrays[2].tobytes()],
                "probes": [int(pdf.docs.sum())],
            }
        )

    return (
        repeated.withColumn("shard", F.pmod(F.xxhash64("h1"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(build, "shard long, slots binary, bits binary, prints binary, counts binary, lasts binary, probes long")
    )


def _unpack(row) -> tuple[list, np.ndarray, np.ndarray]:
    index, at, before = [], 0, 0
    raw = np.frombuffer(row["bits"], np.uint8)
    for slots in np.frombuffer(row["slots"], np.int64).tolist():
        bits = raw[at : at + (slots + 7) // 8]
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(bits))]).astype(np.int64) + before
        index.append((slots, bits, ones[:-1]))
        at, before = at + len(bits), int(ones[-1])
    return index, np.frombuffer(row["prints"], np.int64), np.frombuffer(row["lasts"], np.int64)


def drop_repeated_lines(documents: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of ``documents`` with ``text`` less the repeated lines, ``n_lines`` and ``n_dropped`` (existing ones are replaced)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = Observation()
    counted = counted_lines(documents, min_chars).observe(seen, F.sum("docs").alias("lines"))
    repeated = stage(counted.where(F.col("docs") >= min_docs), "lines")
    shards = max(1, -(-repeated.count() // SHARD_LINES), -(-(seen.get["lines"] or 0) // TASK_PROBES))
    arrays = stage(shard_arrays(repeated, shards), "line-arrays")
    parts = arrays.select("shard", (F.col("probes") / TASK_PROBES + 1).cast("long").alias("parts"))
    probes = (
        _hashes(docs.where("doc_id is not null"), min_chars)
        .withColumn("shard", F.pmod(F.xxhash64("h1"), F.lit(shards)))
        .join(parts, "shard")
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "h1"), F.col("parts")))
        .drop("parts")
    )
    held = arrays.join(parts, "shard").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).drop("parts", "probes", "counts")

    def answer(lines: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = lines[["doc_id", "h1", "h2"]]
        if not len(own) or not len(lines):
            return out.iloc[:0]
        index, prints, lasts = _unpack(own.iloc[0])
        place = look_up(index, lines.h1.to_numpy(np.int64).view(np.uint64))
        known = (place >= 0) & (prints[np.maximum(place, 0)] == lines.h2.to_numpy(np.int64))
        return out[known & (lasts[np.maximum(place, 0)] != lines.doc_id.to_numpy(np.int64))]

    hits = probes.groupBy("shard", "part").cogroup(held.groupBy("shard", "part")).applyInPandas(answer, "doc_id long, h1 long, h2 long")
    drops = hits.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("__drops")).withColumnRenamed("doc_id", "__id")
    joined = documents.drop("n_lines", "n_dropped").join(drops, F.col("doc_id").cast("long") == F.col("__id"), "left")
    return _rebuild(joined, [c for c in documents.columns if c not in ("n_lines", "n_dropped")], min_chars)


def _rebuild(joined: DataFrame, columns: list[str], min_chars: int) -> DataFrame:
    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def keep(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out = []
        for text, rows in zip(texts, drops):
            raw = _bytes(text)
            n = raw.count(b"\n") + 1
            if rows is None or not len(rows):
                out.append((text, n, 0))
                continue
            gone = {np.array([r["h1"], r["h2"]], np.int64).tobytes() for r in rows}
            at = {i for i, d in _long_lines(raw, min_chars) if d in gone}
            out.append((b"\n".join(x for i, x in enumerate(raw.split(b"\n")) if i not in at).decode("utf-8", "replace"), n, len(at)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    made = joined.withColumn("__kept", keep(F.col("text").cast("string"), "__drops"))
    return made.select(*(F.col("__kept.text").alias("text") if c == "text" else F.col(c) for c in columns), "__kept.n_lines", "__kept.n_dropped")
