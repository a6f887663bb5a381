"""Trade cost and profit columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import nonzero


def trade_costs(
    size: Column,
    taker_fee: float = 0.001,
    spread_bps: float = 2.0,
    bar_volume: Column | None = None,
) -> dict[str, Column]:
    """Fee per side, spread and slippage of a position; slippage grows with its share of volume when that is known."""
    fee = size * F.lit(taker_fee)
    spread = size * F.lit(spread_bps / 10_000)
    slip_bps = F.lit(1.0)
    if bar_volume is not None:
        scaled = F.least(1.0 + 0.5 * (size / bar_volume) * 10_000, F.lit(20.0))
        slip_bps = F.when(bar_volume > 0, scaled).otherwise(slip_bps)
    slippage = size * (slip_bps / 10_000)
    return {
        "entry_fee": fee,
        "exit_fee": fee,
        "spread_cost": spread,
        "slippage": slippage,
        "total": fee + fee + spread + slippage,
    }


def spot_pnl(direction: Column, entry: Column, exit_: Column, size: Column) -> Column:
    """Gross profit of a BUY or SELL position before costs."""
    change = (exit_ - entry) / nonzero(entry)
    return F.when(direction == "SELL", -change).otherwise(change) * size
