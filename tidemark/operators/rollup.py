"""Maintained rollups from bars that merge.

A partial bar keeps, beside its prices, the (time, seq) of its open and of its close, so any two partial bars of one
bucket merge into one whatever order their ticks came in, equal times are settled by ``seq``, and an hour is built
from its five-minute bars.  New ticks only ever append: a micro-batch adds one small row per bucket it touches, in a
folder of its own that a repeated batch replaces.  Readers merge.  ``refresh`` merges the stored rows of the last days
into one per bucket; it writes before anything is left out, so a failed run changes nothing.

Ticks older than ``days`` before the newest one of earlier batches are kept apart in ``path/late`` and not counted in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import staging
from tidemark.functions.intervals import floor_to
from tidemark.operators.resample import BAR
from tidemark.sources import store

BASE = "5m"
PARTIAL = (
    "symbol string, ts timestamp, open double, open_at struct<ts: timestamp, seq: bigint>, high double, low double, "
    "close double, close_at struct<ts: timestamp, seq: bigint>, volume double, ticks bigint"
)
STORED = PARTIAL + ", day string, kind string, batch int"
MERGED, ADDED = "merged", "added"


def partial_bars(ticks: DataFrame, interval: str = BASE, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mergeable bars of ticks (``ts, seq, price, qty``)."""
    at = F.struct("ts", F.col("seq").cast("long").alias("seq"))
    return (
        ticks.withColumn("_at", at)
        .groupBy(*keys, floor_to(F.col("ts"), interval).alias("_start"))
        .agg(
            F.min_by("price", "_at").alias("open"), F.min("_at").alias("open_at"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", "_at").alias("close"), F.max("_at").alias("close_at"), F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("ticks"),
        )
        .withColumnRenamed("_start", "ts")
    )


def merge(parts: DataFrame, interval: str = BASE, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Partial bars of an interval from partial bars of the same or a shorter one."""
    return (
        parts.groupBy(*keys, floor_to(F.col("ts"), interval).alias("_start"))
        .agg(
            F.min_by("open", "open_at").alias("open"), F.min("open_at").alias("open_at"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "close_at").alias("close"), F.max("close_at").alias("close_at"), F.sum("volume").alias("volume"), F.sum("ticks").alias("ticks"),
        )
        .withColumnRenamed("_start", "ts")
    )


def bars(parts: DataFrame, interval: str = BASE, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Plain bars of stored partial bars."""
    return merge(parts, interval, keys).select(*keys, "ts", *BAR)


# storage ---------------------------------------------------------------------------------------


def _write(parts: DataFrame, path: str, kind: str, batch: int) -> None:
    """Rows of one batch, by day; writing the same batch again replaces it."""
    rows = parts.withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "kind": F.lit(kind), "batch": F.lit(batch)})
    rows = rows.repartitionByRange("day", "symbol", "ts").sortWithinPartitions("day", "symbol", "ts")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "kind", "batch").parquet(f"{path}/parts")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All partial bars that count: of each day its newest merged rows and what was added after them."""
    rows = spark.read.schema(STORED).parquet(f"{path}/parts")
    newest = rows.filter(F.col("kind") == MERGED).groupBy("day").agg(F.max("batch").alias("_merged"))
    rows = rows.join(newest, "day", "left")
    current = F.when(F.col("kind") == MERGED, F.col("batch") == F.col("_merged")).otherwise(F.col("_merged").isNull() | (F.col("batch") > F.col("_merged")))
    return rows.filter(current).drop("_merged")


def refresh(spark: SparkSession, path: str, as_of: str, days: int = 2) -> None:
    """Merge the stored rows of the last ``days`` days before ``as_of`` to one per bucket; other days are not touched."""
    recent = F.col("day") >= F.date_format(F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"), "yyyy-MM-dd")
    rows = stored(spark, path).filter(recent)
    upto = rows.agg(F.max("batch")).first()[0]
    if upto is not None:
        _write(staging.save(merge(rows), "merged-bars"), path, MERGED, upto)


def sink(path: str, days: int = 2, refresh_every: int | None = None) -> Callable[[DataFrame, int], None]:
    """A stream sink that keeps the rollups of ``symbol, ts, seq, price, qty``; late ticks go to ``path/late``."""

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ticks = staging.save(batch.select("symbol", "ts", "seq", "price", "qty"), "ticks")
        high = _high(spark, path, batch_id)
        late = F.lit(False) if high is None else F.col("ts") < F.lit(high) - F.expr(f"INTERVAL {days} DAYS")
        _by_batch(ticks.filter(late), f"{path}/late", batch_id)
        kept = ticks.filter(~late)
        _write(partial_bars(kept), path, ADDED, batch_id)
        _by_batch(kept.agg(F.max("ts").alias("high")), f"{path}/high", batch_id)
        if refresh_every and batch_id % refresh_every == refresh_every - 1 and high is not None:
            refresh(spark, path, high, days)

    return process


def _by_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _high(spark: SparkSession, path: str, batch_id: int):
    """Time of the newest tick of the batches before this one."""
    if not store.exists(spark, f"{path}/high"):
        return None
    marks = spark.read.schema("high timestamp, batch int").parquet(f"{path}/high")
    return marks.filter(F.col("batch") < batch_id).agg(F.max("high")).first()[0]


def late_ticks(spark: SparkSession, path: str) -> DataFrame:
    """Ticks that came too late to count, with their micro-batch."""
    return spark.read.schema("symbol string, ts timestamp, seq long, price double, qty double, batch int").parquet(f"{path}/late")
