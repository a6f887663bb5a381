"""Mixing sources to target weights by packed blocks and per-source index permutations.

The words of a source are packed, document after document, into blocks of ``block_words`` words.  Sources get targets
by weight; each output shard draws its number of blocks per source from a multinomial over what the sources still
owe, so that the shards together meet the targets.  The slots of a source are numbered through all shards; slot
``j`` takes block ``p(j mod n)``, where ``p`` is the source's pseudorandom permutation of its ``n`` blocks (a Feistel
network walked until it lands inside).  So a source is read through once before any block repeats, and blocks and slots
meet in one join by index.

What the driver sees is one row per source (``MAX_SOURCES`` at most, else an error) and the draws per shard.  A large source is
packed in several streams of about ``STREAM_WORDS`` words by a hash of id and text, so no window holds a whole source (rows that
repeat both share a stream).  The last slot of a source takes only the words that it still owes.

Defined results: null and empty texts have no words and are never taken; a null source is a source of its own, last in
order; a target is at most ``most`` times its source's words; repeated rows are documents of their own; empty
input gives an empty mix; other columns are not read.  The mix depends on ``seed`` and the data alone, not on files or partitions;
of rows that repeat id and text it is left to chance which takes which of their shares.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import stage
from tidemark.llm.words import flat, mix, spans

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 128
SHARD_SLOTS = 8192
STREAM_WORDS = 500_000
MAX_SOURCES = 200_000


def sizes(documents: DataFrame, row: str | None = None) -> DataFrame:
    """``row, doc_id, source, size, key``: the words of each document row and a hash of its id and text; ``row`` names a column that numbers the rows already."""

    def count(batches):
        for batch in batches:
            _, _, _, first = spans(*flat(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(first)), batch.column(3), batch.column(4)], ["doc_id", "source", "size", "row", "key"])

    number = F.col(row) if row else F.monotonically_increasing_id()
    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    docs = documents.select(id_.alias("doc_id"), F.col("source").cast("string"), text.alias("text"), number.alias("row"), F.xxhash64(id_, text).alias("key"))
    return docs.mapInArrow(count, "doc_id long, source string, size long, row long, key long")


def targets(words: np.ndarray, weights: np.ndarray, total: float, most: float = MOST) -> np.ndarray:
    """Shares of ``total`` by weight; a share above ``most`` times its words stops there and the excess is shared anew."""
    out, open_ = np.zeros(len(words)), np.ones(len(words), bool)
    limit = most * words
    while open_.any():
        left = max(total - out[~open_].sum(), 0.0)
        share = left * weights / weights[open_].sum()
        above = open_ & (share > limit)
        if not above.any():
            out[open_] = share[open_]
            break
        out[above] = limit[above]
        open_ &= ~above
    return out


def draws(owed: np.ndarray, shard_slots: int, seed: int) -> np.ndarray:
    """Blocks per (shard, source): a multinomial per shard over what is still owed, never beyond it."""
    rng, left, out = np.random.default_rng(seed), owed.copy(), []
    while left.sum() > 0:
        n, row = int(min(shard_slots, left.sum())), np.zeros(len(left), np.int64)
        while n:  # what a source cannot give is drawn again from the others
            got = np.minimum(rng.multinomial(n, left / left.sum()), left)
            row, left, n = row + got, left - got, n - int(got.sum())
        out.append(row)
    return np.array(out, np.int64).reshape(len(out), len(owed))


def permuted(at: np.ndarray, n: int, key: int) -> np.ndarray:
    """The places of indices ``at`` (0..n-1) under a permutation of 0..n-1 chosen by ``key``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out, todo = np.array(at, np.uint64), np.ones(len(at), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for turn in range(4):
            left, right = right, left ^ (mix(right + np.uint64((key * 4 + turn) * 0x9E3779B97F4A7C15 % 2**64)) & low)
        out[todo] = left << np.uint64(half) | right
        todo &= out >= np.uint64(n)
    return out.astype(np.int64)


def mix_sources(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS,
                shard_slots: int = SHARD_SLOTS, seed: int = 17, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables: documents (``row, doc_id, source, size, source_size, target``) and the mix.

    The mix has one row per piece: output ``shard`` and ``slot``, ``row`` and ``doc_id`` of the document, its first word in
    the document and the number of words.
    """
    spark = documents.sparkSession
    sized = stage(sizes(documents, row), "sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("words")).limit(MAX_SOURCES + 1).toArrow().to_pylist()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    words = np.array([r["words"] for r in found], float)
    weight = np.array([weights[i % len(weights)] for i in range(len(found))], float)
    goal = targets(words, weight, share * words.sum(), most)
    listed = spark.createDataFrame(
        [(i, r["source"], int(words[i]), float(goal[i]), int(-(-words[i] // STREAM_WORDS)) or 1) for i, r in enumerate(found)],
        "sid int, __source string, source_size long, target double, streams long",
    )
    docs = stage(
        sized.join(F.broadcast(listed), F.col("source").eqNullSafe(F.col("__source"))).withColumn("stream", F.pmod(F.xxhash64("key"), F.col("streams"))).drop("__source"), "sources"
    )
    full = docs.where("size > 0")
    streams = full.groupBy("sid", "stream").agg(F.sum("size").alias("words")).withColumn("blocks", F.ceil(F.col("words") / block_words))
    before = Window.partitionBy("sid").orderBy("stream").rowsBetween(Window.unboundedPreceding, -1)
    streams = stage(streams.withColumn("from_block", F.coalesce(F.sum("blocks").over(before), F.lit(0).cast("long"))), "streams")
    blocks = np.zeros(len(found), np.int64)
    for r in streams.groupBy("sid").agg(F.sum("blocks").alias("n")).collect():  # a row per source
        blocks[r["sid"]] = r["n"]
    owed = np.zeros(len(found), np.int64)
    some = blocks > 0
    mean = words[some] / blocks[some]
    owed[some] = np.minimum(np.ceil(goal[some] / mean - 1e-9), np.ceil(most) * blocks[some]).astype(np.int64)
    last = np.zeros(len(found), np.int64)  # the last slot of a source takes what is still owed, no whole block
    last[some] = np.rint(goal[some] - (owed[some] - 1) * mean)
    along = Window.partitionBy("sid", "stream").orderBy("doc_id", "key", "row").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        full.withColumn("at", F.coalesce(F.sum("size").over(along), F.lit(0).cast("long")))
        .join(streams.select("sid", "stream", "from_block"), ["sid", "stream"])
        .select("sid", "row", "doc_id", "size", "at", "from_block", F.explode(F.expr(f"sequence(at div {block_words}, (at + size - 1) div {block_words})")).alias("b"))
        .select(
            "sid", "row", "doc_id", (F.col("from_block") + F.col("b")).alias("block"),
            F.greatest(F.col("b") * block_words - F.col("at"), F.lit(0)).alias("first_word"),
            (F.least((F.col("b") + 1) * block_words, F.col("at") + F.col("size")) - F.greatest(F.col("b") * block_words, F.col("at"))).alias("n_words"),
            F.greatest(F.col("at") - F.col("b") * block_words, F.lit(0)).alias("in_block"),
        )
    )
    slots = _slots(spark, draws(owed, shard_slots, seed), blocks, seed, last, block_words)
    words_left = F.least("n_words", F.col("room") - F.col("in_block"))
    return docs.select("row", "doc_id", "source", "size", "source_size", "target"), pieces.join(slots.hint("merge"), ["sid", "block"]).where("room > in_block").select(
        "shard", "slot", "sid", "row", "doc_id", "first_word", words_left.alias("n_words")
    )


def _slots(spark, drawn: np.ndarray, blocks: np.ndarray, seed: int, last: np.ndarray, block_words: int) -> DataFrame:
    """``shard, slot, sid, block, room``: which block each slot of the output takes, and how many of its first words."""
    first = np.vstack([np.zeros((1, drawn.shape[1]), np.int64), np.cumsum(drawn, 0)[:-1]]) if len(drawn) else drawn
    shard, sid = np.nonzero(drawn)
    plan = pa.table({"shard": shard, "sid": sid.astype(np.int32), "first": first[shard, sid], "n": drawn[shard, sid], "blocks": blocks[sid], "end": drawn.sum(0)[sid] - 1, "last": last[sid]})

    def fill(batches):
        for batch in batches:
            for r in batch.to_pylist():
                slot = r["first"] + np.arange(r["n"], dtype=np.int64)
                taken = permuted(slot % r["blocks"], r["blocks"], seed * 1_000_003 + r["sid"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slot), r["shard"], np.int64)), pa.array(slot), pa.array(np.full(len(slot), r["sid"], np.int32)), pa.array(taken), pa.array(np.where(slot == r["end"], r["last"], block_words))],
                    ["shard", "slot", "sid", "block", "room"],
                )

    parts = max(1, min(len(shard), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(plan, "shard long, sid int, first long, n long, blocks long, end long, last long").repartition(parts).mapInArrow(fill, "shard long, slot long, sid int, block long, room long")


def taken_words(documents: DataFrame, **options) -> DataFrame:
    """Per document row: ``doc_id, size, source_size, target`` and the words the mix takes from it."""
    return taken_by_row(documents, **options).drop("row")


def taken_by_row(documents: DataFrame, **options) -> DataFrame:
    """Per document row: ``row, doc_id, size, source_size, target`` and the words the mix takes from it."""
    docs, mixed = mix_sources(documents, **options)
    taken = mixed.groupBy("row").agg(F.sum("n_words").alias("taken"))
    return docs.join(taken, "row", "left").select("row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
