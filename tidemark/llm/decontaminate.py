"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

Every window of ``window`` consecutive item words must be wholly contained in a document to count.  Its
shingles (runs of ``shingle`` words) are ordered by their number of occurrences in all documents; as containment
must be complete, the necessary prefix is the single rarest shingle, and a window with a shingle that occurs
nowhere is out at once.  Documents meet windows on prefix shingles only; the offset of the shingle in the window
must leave room in the document on both sides (length and positional bounds), and the words are then compared
themselves.  A fixed-size bitmap of the prefix shingles keeps other document positions out of the join.

Defined results: null and empty texts have no words and no hits; an item of fewer words than a window, but not
none, is one window; items without words and null item ids are never found; the same window in several items
counts for each of them; repeated document rows are judged separately; an empty benchmark leaves all
documents clean; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import membership, passes, stage
from tidemark.llm.words import ALNUM, flat, inside_texts, runs, spans

WINDOW = 13
SHINGLE = 5


def _words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> str:
    return b" ".join(data[s : s + n].tobytes() for s, n in zip(starts, sizes)).lower().decode("utf-8", "replace")


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per item and window: its words, their number, and the hash of each shingle."""

    def cut(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            hashes, start, size, first = spans(data, offsets, ALNUM)
            out: list[tuple] = []
            for i, item in enumerate(batch.column(0).to_pylist()):
                low, high = int(first[i]), int(first[i + 1])
                n = min(window, high - low)
                if item is None or not n:
                    continue
                k = min(shingle, n)
                for at in range(low, high - n + 1):
                    out.append((item, _words(data, start[at : at + n], size[at : at + n]), n, k, runs(hashes[at : at + n], k).view(np.int64).tolist()))
            yield pa.RecordBatch.from_pylist([dict(zip(_WINDOW.names, row)) for row in out], _WINDOW)

    return items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string")).mapInArrow(
        cut, "item string, words string, n int, k int, shingles array<long>"
    )


_WINDOW = pa.schema([("item", pa.string()), ("words", pa.string()), ("n", pa.int32()), ("k", pa.int32()), ("shingles", pa.list_(pa.int64()))])
_FOUND = pa.list_(pa.struct([("at", pa.int32()), ("hash", pa.int64()), ("ctx_at", pa.int32()), ("ctx", pa.string())]))


def _occurrences(docs: DataFrame, bitmap, ks: list[int]) -> DataFrame:
    """How often each shingle that passes the filter occurs in all documents."""

    def count(batches):
        for batch in batches:
            hashes, _, _, first = spans(*flat(batch.column(0)), ALNUM)
            found = []
            for k in ks:
                h = runs(hashes, k)
                hit = passes(bitmap.value, h)
                found.append(h[hit[inside_texts(first, k)[hit]]])
            value, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])

    return docs.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("count"))


def _candidates(docs: DataFrame, bitmap, ks: list[int], window: int) -> DataFrame:
    """Per document its number of words and the positions of prefix shingles with the words around them."""

    def find(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            hashes, start, size, first = spans(data, offsets, ALNUM)
            rows: dict[int, list] = {}
            for k in ks:
                h = runs(hashes, k)
                hit = passes(bitmap.value, h)
                hit = hit[inside_texts(first, k)[hit]]
                doc = np.searchsorted(first, hit, "right") - 1
                for at, d in zip(hit.tolist(), doc.tolist()):
                    low, high = max(int(first[d]), at - window + 1), min(int(first[d + 1]), at + window)
                    rows.setdefault(d, []).append(
                        {"at": at - int(first[d]), "hash": int(h[at].view(np.int64)), "ctx_at": low - int(first[d]), "ctx": _words(data, start[low:high], size[low:high])}
                    )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(first)), pa.array([rows.get(d) for d in range(batch.num_rows)], _FOUND)],
                ["doc_id", "n_words", "found"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        find, "doc_id long, n_words long, found array<struct<at:int,hash:long,ctx_at:int,ctx:string>>"
    )


def _covered(starts_and_ends: str) -> F.Column:
    """Number of positions inside any of the intervals (an array of start, end sorted by start)."""
    return F.expr(
        f"aggregate({starts_and_ends}, struct(cast(0 as bigint) as total, cast(0 as bigint) as reach), "
        "(a, x) -> struct(a.total + greatest(cast(x.end as bigint) - greatest(cast(x.start as bigint), a.reach), 0L) as total, "
        "greatest(a.reach, cast(x.end as bigint)) as reach), a -> a.total)"
    )


def find_contamination(documents: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per document row: ``doc_id, n_words, n_hit, items`` (sorted ids as text) and ``hits`` (start, end in words)."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = stage(item_windows(items, window, shingle), "windows")
    ks = sorted(r[0] for r in windows.select("k").distinct().collect()) or [shingle]  # at most ``shingle`` values
    distinct = windows.groupBy("words", "n", "k").agg(F.collect_set("item").alias("items"), F.first("shingles").alias("shingles"))
    listed = distinct.select("words", "n", "items", F.posexplode("shingles").alias("offset", "hash"))
    bitmap = spark.sparkContext.broadcast(membership(listed, "hash"))
    counts = _occurrences(docs, bitmap, ks)
    rarest = (
        listed.join(counts, "hash", "left")
        .groupBy("words", "n", "items")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "hash", "offset")).alias("first"))
        .where("first.count > 0")
        .select("words", "n", "items", "first.hash", "first.offset")
    )
    prefixes = stage(rarest.groupBy("hash").agg(F.collect_list(F.struct("offset", "n", "words", "items")).alias("windows")), "prefixes")
    bitmap = spark.sparkContext.broadcast(membership(prefixes, "hash"))
    scanned = stage(_candidates(docs, bitmap, ks, window).withColumn("row", F.monotonically_increasing_id()), "candidates")
    place = "c.at - w.offset"
    met = (
        scanned.select("row", "n_words", F.explode("found").alias("c"))
        .select("row", "n_words", "c", F.col("c.hash").alias("hash"))
        .join(prefixes, "hash")
        .select(
            "row",
            F.expr(
                "transform(filter(windows, w -> "
                f"{place} >= 0 and {place} + w.n <= n_words and "
                f"array_join(slice(split(c.ctx, ' '), {place} - c.ctx_at + 1, w.n), ' ') = w.words), "
                f"w -> struct({place} as start, {place} + w.n as end, w.items as items))"
            ).alias("hit"),
        )
        .where("size(hit) > 0")
    )
    hits = (
        met.groupBy("row")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hit"))
        .select(
            "row",
            F.expr("transform(hit, h -> struct(h.start as start, h.end as end))").alias("hits"),
            F.array_sort(F.array_distinct(F.flatten("hit.items"))).alias("items"),
        )
    )
    return scanned.join(hits, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce(_covered("hits"), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "hits",
    )


def contaminated() -> F.Column:
    """The rule on ``n_hit`` and ``n_words``: a twentieth of the words or more are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
