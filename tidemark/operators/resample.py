"""Ticks and bars to bars of a longer interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.intervals import INTERVALS, floor_to, since

BAR = ("open", "high", "low", "close", "volume")


def _bars(df: DataFrame, keys: Sequence[str], start: Column, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    first, high, low, last, volume = fields
    # A single ordering column keeps the aggregate buffer flat, hence hash-aggregated.
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return (
        df.groupBy(*keys, start.alias("_start"))
        .agg(
            F.min_by(first, at).alias("open"),
            F.max(high).alias("high"),
            F.min(low).alias("low"),
            F.max_by(last, at).alias("close"),
            F.sum(volume).alias("volume"),
        )
        .select(*keys, F.col("_start").alias("ts"), *BAR)
        .dropna(subset=list(BAR))
    )


def ticks_to_bars(
    ticks: DataFrame, interval: str, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",)
) -> DataFrame:
    """Bars of ``price`` and ``qty``; pass ``order=("ts", "seq")`` where timestamps repeat."""
    start = F.window("ts", INTERVALS[interval]).start
    return _bars(ticks, keys, start, ("price", "price", "price", "price", "qty"), order)


def resample(
    bars: DataFrame, interval: str, keys: Sequence[str] = ("symbol",), days: int | None = None, as_of=None
) -> DataFrame:
    """Left-closed, left-labelled buckets; empty ones do not appear."""
    if days is not None:
        bars = bars.filter(since(F.col("ts"), as_of, days))
    return _bars(bars, keys, F.window("ts", INTERVALS[interval]).start, BAR, ("ts",))


def resample_calendar(bars: DataFrame, interval: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The three calendar intervals: ``3d`` counted from the first day of the data,
    ``1w`` labelled by its closing Sunday, ``1M`` labelled by the last day of the month."""
    day = F.date_trunc("day", "ts")
    if interval == "1w":
        start = F.date_trunc("week", F.col("ts")) + F.expr("INTERVAL 6 DAYS")
    elif interval == "1M":
        start = F.last_day("ts").cast("timestamp")
    elif interval == "3d":
        origin = bars.groupBy(*keys).agg(F.min(day).alias("_origin"))
        bars = bars.join(origin, list(keys))
        whole = F.floor(F.datediff(F.col("ts"), F.col("_origin")) / 3) * 3
        start = F.date_add(F.col("_origin").cast("date"), whole.cast("int")).cast("timestamp")
    else:
        raise ValueError(f"unknown calendar interval {interval!r}")
    return _bars(bars, keys, start, BAR, ("ts",))


def resample_many(bars: DataFrame, intervals: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Several intervals at once, told apart by ``interval``: one scan and one shuffle for all.

    Each bar counts towards its bucket of every interval; partial aggregation shrinks that
    before the shuffle.
    """
    buckets = F.explode(
        F.array(*(F.struct(F.lit(i).alias("interval"), floor_to(F.col("ts"), i).alias("start")) for i in intervals))
    )
    spread = bars.withColumn("_bucket", buckets).withColumn("interval", F.col("_bucket.interval"))
    return _bars(spread, [*keys, "interval"], F.col("_bucket.start"), BAR, ("ts",))


def rollups(bars: DataFrame) -> DataFrame:
    """The two maintained rollups."""
    return resample_many(bars, ("5m", "1h"))
