"""Position slices of indexed series: folds, train/test splits, recent rows.

A slice is a series of its own: it gets a further key, and positions restart at 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rekey(series: DataFrame, name: str, group: Column, start: Column, length: Column) -> DataFrame:
    return (
        series.withColumn(name, group)
        .withColumns({"_start": start, "_length": length})
        .withColumns({"rn": F.col("rn") - F.col("_start"), "n": F.col("_length")})
        .drop("_start", "_length")
    )


def folds(series: DataFrame, count: int = 4) -> DataFrame:
    """``count`` equal consecutive folds; the last one takes the remainder."""
    width = F.floor(F.col("n") / F.lit(count))
    last = F.lit(count - 1)
    fold = F.when(width > 0, F.least(F.floor(F.col("rn") / width), last)).otherwise(last).cast("int")
    start = F.col("fold") * width
    return _rekey(series, "fold", fold, start, F.when(F.col("fold") == last, F.col("n") - start).otherwise(width))


def holdout(series: DataFrame, share: float = 0.8) -> DataFrame:
    """``split`` is train for the first ``share`` of each series, test for the rest."""
    cut = F.floor(F.col("n") * F.lit(share))
    train = F.col("rn") < cut
    split = F.when(train, "train").otherwise("test")
    return _rekey(
        series, "split", split,
        F.when(F.col("split") == "train", F.lit(0)).otherwise(cut),
        F.when(F.col("split") == "train", cut).otherwise(F.col("n") - cut),
    )


def recent(series: DataFrame, rows: int = 2880, spare: int = 100) -> DataFrame:
    """The last ``min(rows, n - spare)`` rows of each series."""
    kept = F.greatest(F.least(F.lit(rows), F.col("n") - spare), F.lit(0))
    start = F.col("n") - kept
    inside = series.filter(F.col("rn") >= start)
    return inside.withColumns({"rn": F.col("rn") - start, "n": kept})


def last_rows(series: DataFrame, rows: int = 200) -> DataFrame:
    return series.filter(F.col("rn") >= F.col("n") - rows)


def fold_bounds(sliced: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Time bounds of each fold and of everything before it (one small row per fold)."""
    bounds = sliced.groupBy(*keys, "fold").agg(
        F.min("ts").alias("test_start"), F.max("ts").alias("test_end"), F.max("n").alias("test_rows")
    )
    before = Window.partitionBy(*keys).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    return bounds.withColumns(
        {
            "train_start": F.min("test_start").over(before),
            "train_end": F.max("test_end").over(before),
            "train_rows": F.coalesce(F.sum("test_rows").over(before), F.lit(0)),
        }
    )


def usable_folds(sliced: DataFrame, keys: Sequence[str], warmup: int, horizon: int) -> DataFrame:
    """Folds with enough rows before and inside them."""
    return fold_bounds(sliced, keys).filter(
        (F.col("train_rows") >= warmup + horizon + 10) & (F.col("test_rows") >= horizon + 5)
    )
