"""Ordered series split into chunks of bounded size.

A window over a whole symbol puts that symbol into one task.  Here every row gets its
position ``rn`` in its series (and the series length ``n``) from a range-partitioned
sort, and ordered work runs per ``(keys, chunk)``:

* look-back / look-ahead windows see the neighbouring rows as a *halo* copied into
  the chunk;
* running sums, maxima, last-known values and exponentially decayed sums get what came
  before the chunk as a *carry*, combined from one aggregate row per chunk.

Neither the size of one symbol nor its share of the data changes the size of a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import staging

CHUNK_ROWS_CONF = "spark.tidemark.chunkRows"
DEFAULT_CHUNK_ROWS = 65536
# exp(-745.2) is the smallest positive double: older terms add exactly zero.
UNDERFLOW = 745.2


def chunk_rows(spark) -> int:
    return int(spark.conf.get(CHUNK_ROWS_CONF, str(DEFAULT_CHUNK_ROWS)))


def underflow_rows(alpha: float) -> int:
    """Rows after which a decay by ``1 - alpha`` per row has vanished in a double."""
    return 1 if alpha >= 1 else math.ceil(UNDERFLOW / -math.log1p(-alpha)) + 1


def index_rows(
    df: DataFrame, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",), label: str = "series"
) -> DataFrame:
    """Add ``rn`` (0-based position within its keys) and ``n`` (rows of its keys).

    One range shuffle places equal shares of rows into sorted partitions however the
    keys are distributed; positions come from per-partition counts.
    """
    placed = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    table = staging.save(placed, label)
    part = F.shiftright("_pos", 33).alias("_part")
    by_key = Window.partitionBy(*keys)
    parts = (
        table.groupBy(*keys, part)
        .agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .select(
            *keys,
            "_part",
            (
                F.coalesce(
                    F.sum("_rows").over(by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
                )
                - F.col("_first")
            ).alias("_shift"),
            F.sum("_rows").over(by_key).alias("n"),
        )
    )
    return (
        table.withColumn("_part", F.shiftright("_pos", 33))
        .join(parts, [*keys, "_part"])
        .withColumn("rn", F.col("_pos") + F.col("_shift"))
        .drop("_part", "_pos", "_shift")
    )


@dataclass(frozen=True)
class Run:
    """Running ``sum``, ``max`` or ``last`` (non-null) of a column from the series start."""

    out: str
    value: str
    how: str = "sum"


@dataclass(frozen=True)
class Ewm:
    """Exponentially weighted ``mean`` (bias adjusted, NULL until ``min_periods``) or decayed ``sum``."""

    out: str
    value: str
    alpha: float
    min_periods: int = 1
    how: str = "mean"


@dataclass(frozen=True)
class Chunks:
    """Rows of indexed series, grouped by ``keys`` and ``_chunk``; ``_own`` is false on halo rows."""

    df: DataFrame
    keys: tuple[str, ...]
    size: int
    before: int

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_chunk").orderBy("rn")

    def add(self, **columns: Column) -> "Chunks":
        return replace(self, df=self.df.withColumns(columns))

    def drop(self, *columns: str) -> "Chunks":
        return replace(self, df=self.df.drop(*columns))

    def trim(self, rows: int) -> "Chunks":
        """Drop the first ``rows`` halo rows, whose own look-backs were cut off.

        Scans add up halo rows, so columns made by look-back windows must be whole there.
        """
        if rows == 0:
            return self
        start = F.col("_chunk") * self.size - (self.before - rows)
        return replace(self, df=self.df.filter(F.col("rn") >= start), before=self.before - rows)

    def own(self) -> DataFrame:
        return self.df.filter("_own").drop("_own", "_chunk")

    def scan(
        self,
        *specs: Run | Ewm,
        then: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
        then_schema: str = "",
    ) -> "Chunks":
        """Evaluate running and decayed aggregates over the whole series.

        ``then`` may derive further double columns from decayed ones inside the same
        chunk task (it sees the halo rows too).
        """
        if not specs:
            return self
        # Full decay leaves the latest value only, which needs no arithmetic.
        specs = [Run(s.out, s.value, "last") if isinstance(s, Ewm) and s.alpha >= 1 else s for s in specs]
        runs = [s for s in specs if isinstance(s, Run)]
        ewms = [s for s in specs if isinstance(s, Ewm)]
        carried = self.df.join(_carries(self, runs, ewms), [*self.keys, "_chunk"], "left")
        upto = self.window.rowsBetween(Window.unboundedPreceding, 0)
        columns = {}
        for i, s in enumerate(runs):
            carry = F.col(f"_r{i}")
            if s.how == "sum":
                columns[s.out] = F.coalesce(carry, F.lit(0)) + F.coalesce(F.sum(s.value).over(upto), F.lit(0))
            elif s.how == "max":
                columns[s.out] = F.greatest(carry, F.max(s.value).over(upto))
            else:
                columns[s.out] = F.coalesce(F.last(s.value, ignorenulls=True).over(upto), carry)
        df = carried.withColumns(columns).drop(*(f"_r{i}" for i in range(len(runs))))
        if ewms:
            df = _apply_ewms(df, self.keys, ewms, then, then_schema)
        return replace(self, df=df)


def chunked(
    series: DataFrame, keys: Sequence[str] = ("symbol",), before: int = 0, after: int = 0, size: int | None = None
) -> Chunks:
    """Assign rows to chunks, copying ``before`` / ``after`` neighbours into each.

    A row reaches at most two chunks per side because a chunk is never smaller than its halo.
    """
    size = max(size or chunk_rows(series.sparkSession), before, after, 1)
    home = F.floor(F.col("rn") / F.lit(size))
    if before == 0 and after == 0:
        df = series.withColumn("_chunk", home).withColumn("_own", F.lit(True))
    else:
        lo = F.greatest(F.floor((F.col("rn") - after) / F.lit(size)), F.lit(0))
        hi = F.floor((F.col("rn") + before) / F.lit(size))
        if "n" in series.columns:
            hi = F.least(hi, F.floor((F.col("n") - 1) / F.lit(size)))
        df = series.withColumn("_chunk", F.explode(F.sequence(lo, hi))).withColumn("_own", F.col("_chunk") == home)
    return Chunks(df, tuple(keys), size, before)


def _carries(ch: Chunks, runs: Sequence[Run], ewms: Sequence[Ewm]) -> DataFrame:
    """State of every running aggregate just before the first (halo) row of each chunk.

    Own rows are totalled per block ending right where a chunk with its halo starts, so
    block ``k - 1`` and everything older precedes chunk ``k``.
    """
    block = F.floor((F.col("rn") + ch.before) / F.lit(ch.size))
    left = (block + 1) * ch.size - ch.before - 1 - F.col("rn")
    totals = []
    for i, s in enumerate(runs):
        value = F.col(s.value)
        if s.how == "last":
            total = F.max_by(value, F.when(value.isNotNull(), F.col("rn")))
        else:
            total = {"sum": F.sum, "max": F.max}[s.how](value)
        totals.append(total.alias(f"_r{i}"))
    for i, s in enumerate(ewms):
        value, weight = F.col(s.value), F.pow(F.lit(1.0 - s.alpha), left)
        totals.append(F.coalesce(F.sum(value * weight), F.lit(0.0)).alias(f"_n{i}"))
        totals.append(F.coalesce(F.sum(F.when(value.isNotNull(), weight)), F.lit(0.0)).alias(f"_d{i}"))
        totals.append(F.count(value).alias(f"_c{i}"))
    blocks = ch.df.filter("_own").groupBy(*ch.keys, block.alias("_chunk")).agg(*totals)

    ordered = Window.partitionBy(*ch.keys).orderBy("_chunk")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    out = []
    for i, s in enumerate(runs):
        name = f"_r{i}"
        if s.how == "last":
            out.append(F.last(name, ignorenulls=True).over(earlier).alias(name))
        else:
            out.append({"sum": F.sum, "max": F.max}[s.how](name).over(earlier).alias(name))
    for i, s in enumerate(ewms):
        reach = math.ceil(underflow_rows(s.alpha) / ch.size) + 1
        recent = ordered.rowsBetween(-reach, -1)
        for name in (f"_n{i}", f"_d{i}"):
            out.append(_faded_sum(F.collect_list(name).over(recent), (1.0 - s.alpha) ** ch.size).alias(name))
        out.append(F.coalesce(F.sum(f"_c{i}").over(earlier), F.lit(0)).alias(f"_c{i}"))
    return blocks.select(*ch.keys, "_chunk", *out)


def _faded_sum(values: Column, fade: float) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total * F.lit(fade) + x)


def _decayed(values: np.ndarray, keep: float, powers: np.ndarray, carry: float) -> np.ndarray:
    geometric = (1.0 - powers) / (1.0 - keep)
    local = pd.Series(values).ewm(alpha=1.0 - keep, adjust=True).mean().to_numpy() * geometric
    return local + powers * carry


def _apply_ewms(df, keys, ewms, then, then_schema) -> DataFrame:
    scratch = [f"_{c}{i}" for i in range(len(ewms)) for c in "ndc"]
    fields = [f for f in df.schema.fields if f.name not in scratch]
    fields += [T.StructField(s.out, T.DoubleType()) for s in ewms]
    if then_schema:
        fields += T.StructType.fromDDL(then_schema).fields
    schema = T.StructType(fields)
    names = schema.names

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        # Rows usually arrive in order, behind a window over the same chunks.
        if not pdf["rn"].is_monotonic_increasing:
            pdf = pdf.sort_values("rn", ignore_index=True)
        steps = np.arange(1, len(pdf) + 1)
        made = {}
        for i, s in enumerate(ewms):
            n0, d0, c0 = (float(np.nan_to_num(pdf[f"_{c}{i}"].iloc[0])) for c in "ndc")
            keep = 1.0 - s.alpha
            powers = keep**steps
            value = pdf[s.value].to_numpy(dtype=float)
            known = ~np.isnan(value)
            top = _decayed(np.where(known, value, 0.0), keep, powers, n0)
            if s.how == "mean":
                weight = _decayed(known.astype(float), keep, powers, d0)
                enough = (c0 + np.cumsum(known) >= s.min_periods) & (weight > 0)
                top = np.divide(top, weight, out=np.full(len(pdf), np.nan), where=enough)
            made[s.out] = top
        pdf = pdf.drop(columns=scratch).assign(**made)
        return (then(pdf) if then else pdf)[names]

    return df.groupBy(*keys, "_chunk").applyInPandas(finish, schema)
