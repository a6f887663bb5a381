"""Episodes from signals: entry at the next open, exit at the first barrier touched."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import staging
from tidemark.functions.costs import spot_pnl, trade_costs
from tidemark.functions.numbers import half_up
from tidemark.plans.cooldown import thin
from tidemark.plans.series import Chunks, chunk_rows, chunked

CHUNK = 8192  # positions per task of the barrier search
TASK_ENTRIES = 1 << 17  # entries of one task, where several runs share the bars


def candidates(ch: Chunks, warmup: int = 50, horizon: Column | int = 12) -> DataFrame:
    """Rows that may open an episode, with the price and time of the following bar.

    The chunks need one look-ahead row; a full horizon must fit behind the entry.
    """
    horizon = F.lit(horizon) if isinstance(horizon, int) else horizon
    ch = ch.add(entry_price=F.lead("open").over(ch.window), entry_ts=F.lead("ts").over(ch.window))
    return (
        ch.own()
        .filter((F.col("signal") != 0) & (F.col("rn") >= warmup) & (F.col("rn") + 1 + horizon < F.col("n")))
        .select(*ch.keys, "rn", "n", "signal", "entry_price", "entry_ts")
    )


def first_touch(
    entries: DataFrame, bars: DataFrame, run_keys: Sequence[str], bar_keys: Sequence[str], max_horizon: int
) -> DataFrame:
    """Label each entry with the first barrier its following bars touch.

    ``entries`` carry ``rn, signal, entry_price, entry_ts, tp, sl, horizon``.  Entries meet
    the bars of their position chunk plus one horizon of look-ahead rows, and all entries
    of a task search the chunk's doubling tables at once: time grows with the logarithm of the
    horizon and memory with the chunk, not with entries times horizon.  One run has at most
    ``CHUNK`` entries in a chunk; where several share the bars, a chunk's entries are counted and
    dealt to as many tasks as they need, and only chunks with entries are read.
    """
    size = max(min(CHUNK, chunk_rows(entries.sparkSession)), max_horizon)
    dealt = entries.withColumn("_chunk", F.floor(F.col("rn") / F.lit(size)))
    path = chunked(bars.select(*bar_keys, "rn", "n", "ts", "high", "low", "close"), bar_keys, after=max_horizon, size=size).df
    lane = F.lit(0).cast("long")
    if set(run_keys) - set(bar_keys):
        dealt = staging.save(dealt, "entries")
        lanes = dealt.groupBy(*bar_keys, "_chunk").agg(F.ceil(F.count(F.lit(1)) / TASK_ENTRIES).alias("_lanes"))
        dealt = dealt.join(lanes, [*bar_keys, "_chunk"])
        dealt = dealt.withColumn("_lane", F.pmod(F.xxhash64(*run_keys, "rn"), F.col("_lanes"))).drop("_lanes")
        path = path.join(lanes, [*bar_keys, "_chunk"])
        lane = F.explode(F.sequence(lane, F.col("_lanes") - 1))
    else:
        dealt = dealt.withColumn("_lane", lane)
    path = path.select(
        *(F.col(k).alias(f"_{k}") for k in bar_keys),
        F.col("_chunk").alias("_at"),
        lane.alias("_of"),
        F.col("rn").alias("_rn"),
        F.unix_micros("ts").alias("_us"),
        *(F.col(c).cast("double").alias(f"_{c}") for c in ("high", "low", "close")),
    )
    columns = entries.columns
    schema = T.StructType(
        [
            *entries.schema.fields,
            T.StructField("exit_reason", T.StringType()),
            T.StructField("exit_raw", T.DoubleType()),
            T.StructField("horizon_bars", T.LongType()),
            T.StructField("_exit_us", T.LongType()),
        ]
    )

    def label(found: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        if found.empty or path.empty:
            return pd.DataFrame(columns=schema.names)
        path = path.sort_values("_rn", ignore_index=True)
        return found[columns].assign(**_label(found, path))[schema.names]

    labelled = (
        dealt.groupBy(*bar_keys, "_chunk", "_lane")
        .cogroup(path.groupBy(*(f"_{k}" for k in bar_keys), "_at", "_of"))
        .applyInPandas(label, schema)
    )
    return labelled.withColumn("exit_ts", F.timestamp_micros("_exit_us")).drop("_exit_us")


def _doubling(values: np.ndarray, pick: Callable, levels: int) -> list[np.ndarray]:
    """``pick`` (max or min) over the ``2 ** k`` rows from each row on, for each level ``k``; shorter at the end."""
    tables = [values]
    for k in range(levels):
        below = tables[-1]
        tables.append(pick(below[: -(1 << k)], below[1 << k :]) if len(below) > 1 << k else below[:0])
    return tables


def first_outside(high: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """First row in ``[start, end)`` whose high reaches ``upper`` or whose low reaches ``lower``, else ``end``.

    A galloping search over doubling tables: strides double while a stretch touches neither
    barrier, then halve.  Missing highs and lows, and missing barriers, touch nothing.
    """
    levels = int(max(int((end - start).max(initial=1)), 1)).bit_length()
    top = _doubling(np.where(np.isnan(high), -np.inf, high), np.maximum, levels)
    bottom = _doubling(np.where(np.isnan(low), np.inf, low), np.minimum, levels)
    at = start.astype(np.int64).copy()
    active = np.arange(len(at))

    def stride(k: int, rows: np.ndarray) -> np.ndarray:
        """Moves the rows whose next ``2 ** k`` bars fit and touch nothing; returns those moved."""
        rows = rows[at[rows] + (1 << k) <= end[rows]]
        here = at[rows]
        clear = ~((top[k][here] >= upper[rows]) | (bottom[k][here] <= lower[rows]))
        at[rows[clear]] += 1 << k
        return rows[clear]

    for k in range(levels + 1):
        active = stride(k, active)
        if not len(active):
            break
    for k in range(levels, -1, -1):
        stride(k, np.arange(len(at)))
    return at


def _label(found: pd.DataFrame, path: pd.DataFrame) -> dict[str, np.ndarray]:
    """Exits of a chunk's entries."""
    start = (found["rn"] - path["_rn"].iloc[0] + 1).to_numpy()
    horizon = found["horizon"].to_numpy()
    high, low, close = (path[c].to_numpy(dtype=float) for c in ("_high", "_low", "_close"))
    end = np.minimum(start + horizon, len(path))
    entry, tp, sl = (found[c].to_numpy(dtype=float) for c in ("entry_price", "tp", "sl"))
    long = found["signal"].to_numpy() == 1
    target = np.where(long, entry * (1 + tp), entry * (1 - tp))
    stop = np.where(long, entry * (1 - sl), entry * (1 + sl))
    at = first_outside(high, low, start, end, np.where(long, target, stop), np.where(long, stop, target))
    touched = at < end
    bars = np.where(touched, at - start, horizon - 1)
    leave = np.minimum(start + bars, len(path) - 1)
    stopped = touched & np.where(long, low[leave] <= stop, high[leave] >= stop)
    # A bar that touches both barriers is a stop.
    reason = np.where(touched, np.where(stopped, "sl", "tp"), "horizon")
    return {
        "exit_reason": reason.astype(object),
        "exit_raw": np.where(touched, np.where(stopped, stop, target), close[leave]),
        "horizon_bars": bars.astype(np.int64),
        "_exit_us": path["_us"].to_numpy()[leave],
    }


def price(
    episodes: DataFrame, run_keys: Sequence[str], size: float = 50.0, taker_fee: float = 0.001, spread_bps: float = 2.0
) -> DataFrame:
    """Trade table: rounded money columns plus the unrounded ``net_raw``."""
    amount = F.lit(float(size))
    direction = F.when(F.col("signal") == 1, "BUY").otherwise("SELL")
    costs = trade_costs(amount, taker_fee, spread_bps)
    gross = spot_pnl(direction, F.col("entry_price"), F.col("exit_raw"), amount)
    net = gross - costs["total"]
    return episodes.select(
        *run_keys,
        "rn",
        F.col("entry_ts").alias("ts"),
        direction.alias("direction"),
        half_up(F.col("entry_price"), 2).alias("entry_price"),
        half_up(F.col("exit_raw"), 2).alias("exit_price"),
        "exit_reason",
        "exit_ts",
        F.col("horizon_bars").cast("long").alias("horizon_bars"),
        half_up(gross, 2).alias("gross_pnl"),
        half_up(costs["entry_fee"] + costs["exit_fee"], 4).alias("fees"),
        half_up(costs["spread_cost"], 4).alias("spread_cost"),
        half_up(costs["slippage"], 4).alias("slippage"),
        half_up(net, 2).alias("net_pnl"),
        net.alias("net_raw"),
        F.when(net > 0, "WIN").otherwise("LOSS").alias("outcome"),
    )


def backtest(
    ch: Chunks,
    bars: DataFrame,
    horizon: int = 12,
    warmup: int = 50,
    cooldown: int = 2,
    size: float = 50.0,
    taker_fee: float = 0.001,
    spread_bps: float = 2.0,
    tp: float = 0.005,
    sl: float = 0.005,
) -> DataFrame:
    """Trades of one signal over all series.

    ``ch`` holds signal rows with one look-ahead row, ``bars`` the indexed series they come from.
    """
    kept = thin(candidates(ch, warmup, horizon), ch.keys, cooldown)
    entries = kept.withColumns({"tp": F.lit(float(tp)), "sl": F.lit(float(sl)), "horizon": F.lit(horizon)})
    return price(first_touch(entries, bars, ch.keys, ch.keys, horizon), ch.keys, size, taker_fee, spread_bps)
