"""Metrics of finished runs."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import staging
from tidemark.functions.numbers import half_up
from tidemark.plans.series import chunk_rows

INF = float("inf")


def _ratio(mean: Column, deviation: Column, otherwise: Column) -> Column:
    return F.when(deviation > 0, mean / deviation).otherwise(otherwise)


def trade_metrics(trades: DataFrame, keys: Sequence[str], pnl: str = "net_pnl") -> DataFrame:
    """Counts, win rate, profit and unannualised ratios per run, in one aggregation."""
    x = F.col(pnl)
    loss = F.when(x < 0, x)
    raw = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.count_if(x > 0).alias("wins"),
        F.sum(x).alias("_total"),
        F.avg(x).alias("_avg"),
        F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("_sd"),
        F.coalesce(F.stddev_samp(loss), F.lit(0.0)).alias("_down"),
        F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)).alias("_won"),
        F.coalesce(-F.sum(loss), F.lit(0.0)).alias("_lost"),
    )
    avg, inf = F.col("_avg"), F.lit(INF)
    return raw.select(
        *keys,
        "n_trades",
        "wins",
        (F.col("n_trades") - F.col("wins")).alias("losses"),
        half_up(F.col("wins") / F.col("n_trades"), 4).alias("win_rate"),
        half_up(F.col("_total"), 2).alias("total_pnl"),
        half_up(avg, 2).alias("avg_pnl"),
        half_up(_ratio(avg, F.col("_sd"), F.lit(0.0)), 4).alias("sharpe"),
        _finite(_ratio(avg, F.col("_down"), F.when(avg > 0, inf).otherwise(0.0))).alias("sortino"),
        _finite(F.when(F.col("_lost") > 0, F.col("_won") / F.col("_lost")).otherwise(inf)).alias("profit_factor"),
    )


def _finite(x: Column) -> Column:
    return F.when(x == INF, x).otherwise(half_up(F.when(x != INF, x), 4))


def max_drawdown(rows: DataFrame, keys: Sequence[str], value: str = "net_pnl", position: str = "rn") -> DataFrame:
    """Deepest fall of the running total below its peak (peak starts at 0), as a value <= 0.

    Each chunk is reduced to its total, highest and lowest running total and inner
    drawdown; one small row per chunk then meets the total and peak before it.
    """
    keys = list(keys)
    size = chunk_rows(rows.sparkSession)
    inner = Window.partitionBy(*keys, "_chunk").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    running = (
        rows.select(*keys, position, value, F.floor(F.col(position) / F.lit(size)).alias("_chunk"))
        .withColumn("_cum", F.sum(value).over(inner))
        .withColumn("_peak", F.max("_cum").over(inner))
    )
    chunks = running.groupBy(*keys, "_chunk").agg(
        F.sum(value).alias("_total"),
        F.max("_cum").alias("_high"),
        F.min("_cum").alias("_low"),
        F.min(F.col("_cum") - F.col("_peak")).alias("_fall"),
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    return (
        chunks.withColumn("_base", F.coalesce(F.sum("_total").over(earlier), zero))
        .withColumn("_top", F.greatest(zero, F.max(F.col("_base") + F.col("_high")).over(earlier)))
        .groupBy(*keys)
        .agg(
            F.least(
                zero, F.min("_fall"), F.min(F.col("_base") + F.col("_low") - F.col("_top"))
            ).alias("max_dd")
        )
    )


PRIME = 2_147_483_647
#: Of PRIME equally likely numbers, how many lie at or below each count of a Poisson variable of mean 1 (0, 1, ... 8).
POISSON = tuple(int(PRIME * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(9))
#: Counts by the upper 16 bits of a number; bins that a limit divides hold ``_DIVIDED``.
_DIVIDED = 255
_COUNT_OF_BIN = np.searchsorted(POISSON, np.arange(1 << 16) << 15, "left").astype(np.uint8)
_COUNT_OF_BIN[np.array(POISSON) >> 15] = _DIVIDED
DRAWS_AT_ONCE = 4


def _modulo_prime(x: np.ndarray) -> np.ndarray:
    """``x % PRIME`` for 0 <= x < 2**62, by folding: PRIME is 2**31 - 1."""
    for _ in range(2):
        x = (x & PRIME) + (x >> 31)
    return np.where(x >= PRIME, x - PRIME, x)


def poisson_weights(position: np.ndarray, first_draw: int, draws: int) -> np.ndarray:
    """How often each resample takes each row (rows x draws): a Poisson count from a number of its own per position and draw."""
    draw = np.arange(first_draw, first_draw + draws, dtype=np.int64)[:, None]
    x = _modulo_prime((position.astype(np.int64) % PRIME * 48_271)[None, :] + draw * 69_621 + 7)
    for shift in (1, 3):
        square = x * x
        x = _modulo_prime((square & PRIME) + (square >> 31) + x * shift + draw)
    counts = _COUNT_OF_BIN[x >> 15]
    divided = counts == _DIVIDED
    counts[divided] = np.searchsorted(POISSON, x[divided], "left")
    return counts.astype(float).T


#: How many of the 256 values of a byte stand for each count 0, 1, ... 5: mean and variance are exactly 1.
COUNTS = (94, 95, 46, 16, 4, 1)
_COUNT_OF_BYTE = np.repeat(np.arange(len(COUNTS), dtype=float), COUNTS)
DRAWS_PER_WORD = 4
WORDS_AT_ONCE = 25
#: Multipliers of the position (low and high half), of the word's number, and of the two mixing steps.
MIX = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x7FEB352D, 0x846CA68B)


def draw_weights(position: np.ndarray, first_word: int, words: int) -> np.ndarray:
    """How often each resample takes each row (rows x draws): one mixed 32-bit word of position and number gives four draws."""
    low, high, number, a, b = (np.uint32(m) for m in MIX)
    at = position.astype(np.int64).view(np.uint64)
    base = (at & np.uint64(0xFFFFFFFF)).astype(np.uint32) * low + (at >> np.uint64(32)).astype(np.uint32) * high + np.uint32(1)
    x = base[:, None] + np.arange(first_word, first_word + words, dtype=np.uint32) * number
    x ^= x >> np.uint32(16)
    x *= a
    x ^= x >> np.uint32(15)
    x *= b
    x ^= x >> np.uint32(16)
    return _COUNT_OF_BYTE[x.astype("<u4").view(np.uint8)]


def byte_weights(position: np.ndarray, first_draw: int, draws: int) -> np.ndarray:
    """``draw_weights`` by the number of the draw, four of which share a word."""
    first_word, last_word = first_draw // DRAWS_PER_WORD, -(-(first_draw + draws) // DRAWS_PER_WORD)
    skipped = first_draw - first_word * DRAWS_PER_WORD
    return draw_weights(position, first_word, last_word - first_word)[:, skipped : skipped + draws]


def bootstrap_pvalue(
    rows: DataFrame,
    keys: Sequence[str],
    value: str = "net_pnl",
    position: str = "rn",
    resamples: int = 1000,
    weights: Callable[[np.ndarray, int, int], np.ndarray] = poisson_weights,
    draws_at_once: int = DRAWS_AT_ONCE,
) -> DataFrame:
    """Two-sided p-value of a zero mean: share of centred resamples at least as far out.

    Resamples weigh each row by a Poisson count (or by other ``weights``) that follows from its position and the number of
    the resample, so one pass over the rows of any chunk gives its part of all resamples.  Fewer than five
    values give 1.
    """
    keys = list(keys)
    # Every task makes a thousand weights per row: smaller chunks spread that work.
    size = max(1, chunk_rows(rows.sparkSession) // 8)
    table = rows.select(*keys, F.col(value).cast("double").alias("_value"), F.col(position).cast("long").alias("_position"))
    table = staging.save(table.withColumn("_chunk", F.floor(F.col("_position") / F.lit(size))), "run-rows")
    runs = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("_value").alias("_mean"))
    schema = T.StructType(
        [*(table.schema[k] for k in keys), *(T.StructField(c, T.DoubleType()) for c in ("_sum", "_weight")), T.StructField("_draw", T.LongType())]
    )

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        both = np.stack([pdf["_value"].to_numpy(), np.ones(len(pdf))])
        at = pdf["_position"].to_numpy()
        blocks = ((first, min(draws_at_once, resamples - first)) for first in range(0, resamples, draws_at_once))
        sums = np.concatenate([both @ weights(at, first, draws) for first, draws in blocks], axis=1)
        first = {k: [pdf[k].iloc[0]] * resamples for k in keys}
        return pd.DataFrame({**first, "_sum": sums[0], "_weight": sums[1], "_draw": np.arange(resamples)})

    parts = table.groupBy(*keys, "_chunk").applyInPandas(draw, schema)
    draws = parts.groupBy(*keys, "_draw").agg(F.sum("_sum").alias("_sum"), F.sum("_weight").alias("_weight"))
    far = F.abs(F.coalesce(F.col("_sum") / F.nullif(F.col("_weight"), F.lit(0.0)) - F.col("_mean"), F.lit(0.0))) >= F.abs("_mean")
    judged = draws.join(runs.filter("_n >= 5"), keys).groupBy(*keys).agg(F.avg(far.cast("double")).alias("p_value"))
    return runs.select(*keys).join(judged, keys, "left").fillna(1.0, ["p_value"])


def passes_gates(turnover: Column) -> Column:
    """Quality gate over metric columns (fixed thresholds)."""
    shallow = F.when(turnover > 0, F.abs("max_dd") / turnover <= 0.25).otherwise(F.lit(True))
    return (
        (F.col("n_trades") >= 30)
        & (F.col("win_rate") >= 0.43)
        & (F.col("sharpe") >= 0.5)
        & shallow
        & (F.col("p_value") <= 0.05)
    )


def summarise(
    trades: DataFrame, keys: Sequence[str], size: float = 50.0, runs: DataFrame | None = None, with_pvalue: bool = True
) -> DataFrame:
    """One row per run: metrics, drawdown, p-value and gate.

    Runs listed in ``runs`` that made no trade appear with zeros and p-value 1.
    """
    keys = list(keys)
    # Trades are few next to bars but costly to label; every part below reads them again.
    trades = staging.save(trades, "trades")
    out = trade_metrics(trades, keys).join(
        max_drawdown(trades, keys).withColumn("max_dd", half_up(F.col("max_dd"), 2)), keys
    )
    if with_pvalue:
        out = out.join(bootstrap_pvalue(trades, keys, weights=byte_weights, draws_at_once=DRAWS_PER_WORD * WORDS_AT_ONCE), keys)
    if runs is not None:
        out = runs.select(*keys).distinct().join(out, keys, "left")
        zeros = [c for c in out.columns if c not in keys and c != "p_value"]
        out = out.fillna(0, zeros)
        if with_pvalue:
            out = out.fillna(1.0, ["p_value"])
    if with_pvalue:
        out = out.withColumn("passes_gates", passes_gates(F.col("n_trades") * F.lit(float(size))))
    return out
