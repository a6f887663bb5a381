"""Keyed stateful stream operators and windowed rollups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.intervals import INTERVALS
from tidemark.functions.numbers import half_up, nonzero

GAP_SCHEMA = "symbol string, from_ms long, to_ms long, missing long"
EPISODE_SCHEMA = (
    "symbol string, side string, entry_ts timestamp, exit_ts timestamp, entry_price double, exit_price double, "
    "exit_reason string, bars_held long"
)


def rollup(ticks: DataFrame, interval: str, late: str = "2 days") -> DataFrame:
    """Continuous OHLCV rollup of a tick stream (update mode); later rows than ``late`` are dropped."""
    bucket = F.window("ts", INTERVALS[interval])
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", bucket)
        .agg(
            F.min_by("price", "ts").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "ts").alias("close"),
            F.sum("qty").alias("volume"),
        )
        .select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def once_per_bar(candles: DataFrame, late: str = "2 hours") -> DataFrame:
    """Closed candles once per (symbol, open time) while state is kept; needs a ``ts`` column."""
    closed = candles.filter("is_closed").withWatermark("ts", late)
    return closed.dropDuplicatesWithinWatermark(["symbol", "open_time_ms"])


class _Gaps(StatefulProcessor):
    """Remembers the last open time of a symbol; earlier rows than it are late and ignored."""

    def __init__(self, bar_ms: int):
        self.bar_ms = bar_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(set(pd.concat([r["open_time_ms"] for r in rows])))
        last, found = (self.last.get()[0] if self.last.exists() else None), []
        for at in times:
            if last is not None and at <= last:
                continue
            if last is not None and at > last + self.bar_ms:
                start = last + self.bar_ms
                found.append((key[0], start, at, (at - start) // self.bar_ms))
            last = at
        self.last.update((last,))
        yield pd.DataFrame(found, columns=["symbol", "from_ms", "to_ms", "missing"])

    def close(self) -> None:
        pass


def bar_gaps(candles: DataFrame, bar_ms: int = 60_000) -> DataFrame:
    """Gaps in the open times of a candle stream, per symbol."""
    return candles.groupBy("symbol").transformWithStateInPandas(_Gaps(bar_ms), GAP_SCHEMA, "Append", "None")


class _Episodes(StatefulProcessor):
    """One open position per symbol: target before stop before horizon, then entry at the close."""

    def __init__(self, horizon: int, warmup: int, tp: float, sl: float):
        self.horizon, self.warmup, self.tp, self.sl = horizon, warmup, tp, sl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getValueState("bars", "seen long")
        self.open = handle.getValueState("open", "side int, price double, ts timestamp, bar long")

    def _exit(self, position, row, bar):
        side, price = position[0], position[1]
        target, stop = price * (1 + side * self.tp), price * (1 - side * self.sl)
        if row.high >= target if side == 1 else row.low <= target:
            return target, "tp"
        if row.low <= stop if side == 1 else row.high >= stop:
            return stop, "sl"
        return (row.close, "horizon") if bar - position[3] >= self.horizon else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(rows)).sort_values("ts")
        seen = self.bars.get()[0] if self.bars.exists() else 0
        position = self.open.get() if self.open.exists() else None
        closed = []
        for row in bars.itertuples(index=False):
            bar, seen = seen, seen + 1
            if bar < self.warmup:
                continue
            left = self._exit(position, row, bar) if position else None
            if left:
                side = "LONG" if position[0] == 1 else "SHORT"
                closed.append((key[0], side, position[2], row.ts, position[1], left[0], left[1], bar - position[3]))
                position = None
            if position is None and row.signal != 0:
                position = (int(row.signal), float(row.close), row.ts.to_pydatetime(), bar)
        self.bars.update((seen,))
        if position:
            self.open.update(tuple(position))
        else:
            self.open.clear()
        columns = ["symbol", "side", "entry_ts", "exit_ts", "entry_price", "exit_price", "exit_reason", "bars_held"]
        yield pd.DataFrame(closed, columns=columns)

    def close(self) -> None:
        pass


def episodes(
    bars: DataFrame, horizon: int = 12, warmup: int = 50, tp: float = 0.005, sl: float = 0.005
) -> DataFrame:
    """Closed episodes of a stream of closed bars with a ``signal``, in bar order per symbol."""
    fields = bars.select("symbol", "ts", "high", "low", "close", "signal")
    tracker = _Episodes(horizon, warmup, tp, sl)
    return fields.groupBy("symbol").transformWithStateInPandas(tracker, EPISODE_SCHEMA, "Append", "None")


def priced(closed: DataFrame, size: float = 50.0, fee: float = 0.001) -> DataFrame:
    """Profit columns of closed episodes: fees on both sides, nothing else."""
    change = (F.col("exit_price") - F.col("entry_price")) / nonzero(F.col("entry_price"))
    gross = F.when(F.col("side") == "SHORT", -change).otherwise(change) * size
    fees = F.lit(size * fee * 2)
    return closed.withColumns(
        {
            "gross_pnl": half_up(gross, 2),
            "fees": half_up(fees, 4),
            "net_pnl": half_up(gross - fees, 2),
            "entry_price": half_up(F.col("entry_price"), 2),
            "exit_price": half_up(F.col("exit_price"), 2),
        }
    )


