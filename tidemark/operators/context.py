"""Market summary and account curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import half_up, nonzero
from tidemark.plans.series import Run, chunked, index_rows

REGIMES = (0, 1, 2, 3)
BARS_BACK = 30 * 96


def market_context(features: DataFrame, keys: Sequence[str] = ("symbol",), back: int = BARS_BACK) -> DataFrame:
    """Regime shares, last price, return over ``back`` bars, mean volume and latest ADX per series."""
    rn, n = F.col("rn"), F.col("n")
    then = F.max(F.when(rn == F.greatest(n - back, F.lit(0)), F.col("close")))
    last = F.max_by("close", "rn")
    shares = [F.avg((F.col("regime") == r).cast("double")).alias(f"share_{r}") for r in REGIMES]
    return features.groupBy(*keys).agg(
        *shares,
        last.alias("last_price"),
        ((last - then) / nonzero(then) * 100).alias("return_pct"),
        F.avg("volume").alias("avg_volume"),
        F.max_by("adx_14", "rn").alias("latest_adx"),
    )


def equity_curve(
    trades: DataFrame, keys: Sequence[str] = ("symbol",), initial: float = 10_000.0, order: Sequence[str] = ("exit_ts", "rn")
) -> DataFrame:
    """Account state after each closed trade: running profit, fees, equity and count.

    Unrounded profits (``net_raw``) are added up; only what is reported is rounded.
    """
    closed = trades.select(
        *keys, *order, "net_raw", "fees", F.lit(1).alias("_one"), F.col("rn").alias("trade_rn")
    ).drop("rn")
    order = ["trade_rn" if c == "rn" else c for c in order]
    ch = chunked(index_rows(closed, keys, order, "trades"), keys)
    ch = ch.scan(Run("total_pnl", "net_raw"), Run("total_fees", "fees"), Run("n_trades", "_one"))
    return ch.own().select(
        *keys,
        *order,
        half_up(F.lit(initial) + F.col("total_pnl"), 2).alias("equity"),
        half_up(F.col("total_pnl"), 2).alias("total_pnl"),
        half_up(F.col("total_fees"), 4).alias("total_fees"),
        "n_trades",
    )
