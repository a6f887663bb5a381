"""The feature table: bars, all indicators and aligned external columns, kept up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.intervals import month_of
from tidemark.functions.numbers import nonzero
from tidemark.operators.external import join_external
from tidemark.operators.indicators import ALL, Request, add_all, add_indicators
from tidemark.plans.series import index_rows, underflow_rows
from tidemark.sources import store

# Past rows after which no decayed aggregate of the feature set changes in a double.
CONTEXT_ROWS = underflow_rows(2.0 / 51) + 200
KEYS = ("symbol", "ts")


def write_features(rows: DataFrame, path: str) -> int:
    """Upsert feature rows by (symbol, ts) with the stored types."""
    return store.upsert(store.feature_types(rows), path, keys=KEYS, partitions=(), merge_schema=True)


def _context_start(bars: DataFrame, marks: DataFrame, rows: int) -> DataFrame:
    """Per symbol with stored features: first month from which at least ``rows`` stored rows follow."""
    counts = (
        bars.join(marks, "symbol")
        .filter(F.col("ts") <= F.col("_mark"))
        .groupBy("symbol", month_of(F.col("ts")).alias("_month"))
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("ts").alias("_from"))
    )
    later = Window.partitionBy("symbol").orderBy(F.desc("_month")).rowsBetween(Window.unboundedPreceding, 0)
    enough = counts.withColumn("_after", F.sum("_rows").over(later)).filter(F.col("_after") >= rows)
    return enough.groupBy("symbol").agg(F.max("_from").alias("_from"))


def increment(bars: DataFrame, stored: DataFrame, context_rows: int = CONTEXT_ROWS) -> DataFrame:
    """Feature rows of bars later than the stored ones, equal to what a full rebuild gives.

    Windows and decayed aggregates see enough past rows; the two cumulative indicators
    continue from what precedes those rows.
    """
    marks = stored.groupBy("symbol").agg(F.max("ts").alias("_mark"))
    behind = bars.groupBy("symbol").agg(F.max("ts").alias("_end")).join(marks, "symbol", "left")
    behind = behind.filter(F.col("_mark").isNull() | (F.col("_end") > F.col("_mark"))).select("symbol", "_mark")
    live = bars.join(behind, "symbol")
    starts = _context_start(bars, behind.filter(F.col("_mark").isNotNull()), context_rows)
    bounded = live.join(starts, "symbol", "left")
    inside = F.col("_from").isNull() | (F.col("ts") >= F.col("_from"))
    context = index_rows(bounded.filter(inside).select(*bars.columns, "_mark", "_from"))
    features = add_indicators(context, [*ALL, Request("_volume_run", "cum_volume")])

    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    before = bounded.filter(~inside).groupBy("symbol").agg(
        F.sum(typical * F.col("volume")).alias("_pv0"), F.sum("volume").alias("_v0")
    )
    flow = stored.join(starts, (stored["symbol"] == starts["symbol"]) & (stored["ts"] == starts["_from"])).select(
        stored["symbol"], F.col("obi").alias("_obi0")
    )
    # Cumulative values inside the context continue from the totals before it.
    out = features.join(before, "symbol", "left").join(flow, "symbol", "left")
    carried = F.coalesce("_v0", F.lit(0.0))
    vwap = (F.coalesce("_pv0", F.lit(0.0)) + F.coalesce(F.col("vwap") * F.col("_volume_run"), F.lit(0.0))) / nonzero(
        carried + F.col("_volume_run")
    )
    out = out.withColumns({"vwap": vwap, "obi": F.col("obi") + F.coalesce("_obi0", F.lit(0.0))})
    fresh = F.col("_mark").isNull() | (F.col("ts") > F.col("_mark"))
    return out.filter(fresh).drop("rn", "n", "_mark", "_from", "_pv0", "_v0", "_obi0", "_volume_run")


def build_features(
    bars: DataFrame,
    path: str,
    aligned: DataFrame | None = None,
    sources: Sequence[str] = (),
    rebuild: bool = False,
    context_rows: int = CONTEXT_ROWS,
) -> int:
    """Bring the feature table at ``path`` up to date with ``bars``, all symbols in one job.

    Returns the rows in the months written, 0 if nothing was new.
    """
    stored = None if rebuild else store.read(bars.sparkSession, path, merge_schema=True)
    if stored is None:
        rows = add_all(index_rows(bars)).drop("rn", "n")
    else:
        rows = increment(bars, stored, context_rows)
    if aligned is not None:
        rows = join_external(rows, aligned, sources)
    return write_features(rows, path)


def load(spark: SparkSession, features_path: str, bars: DataFrame) -> DataFrame:
    """Stored features if there are any, else indicators computed from the bars."""
    stored = store.read(spark, features_path, merge_schema=True)
    return stored.drop("month") if stored is not None else add_all(index_rows(bars)).drop("rn", "n")
