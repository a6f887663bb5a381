"""Named signals: 1 enter long, -1 enter short, 0 nothing."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import nonzero
from tidemark.operators.indicators import Request, indicator_chunks
from tidemark.plans.series import Chunks, chunked


def _named(name: str, *params) -> str:
    """Column of an indicator; equal requests of several candidates share it."""
    return "_".join(["_", name, *(str(p).replace(".", "p") for p in params)])


def _request(indicator: str, **params) -> Request:
    return Request(_named(indicator, *params.values()), indicator, params)


def _signed(long: Column, short: Column) -> Column:
    return F.when(short, -1).when(long, 1).otherwise(0)


def _once(ch: Chunks, **columns: Column) -> Chunks:
    return ch.add(**{k: c for k, c in columns.items() if k not in ch.df.columns})


def _rsi(ch: Chunks, rsi_period, oversold, overbought) -> tuple[Chunks, Column]:
    value, quiet = F.col(_named("rsi", rsi_period)), F.col(_named("regime")) == 0
    return ch, _signed((value < oversold) & quiet, (value > overbought) & quiet)


def _macd(ch: Chunks, fast, slow, signal) -> tuple[Chunks, Column]:
    hist, prev = (_named(n, fast, slow, signal) for n in ("macd_hist", "prev_hist"))
    ch = _once(ch, **{prev: F.lag(hist).over(ch.window)})
    hist, prev = F.col(hist), F.col(prev)
    return ch, _signed((hist > 0) & (prev <= 0), (hist < 0) & (prev >= 0))


def _ema(ch: Chunks, fast, medium, slow) -> tuple[Chunks, Column]:
    close = F.col("close")
    fast, medium, slow = (F.col(_named("ema", p)) for p in (fast, medium, slow))
    return ch, _signed((close > slow) & (fast > medium), (close < slow) & (fast < medium))


def _vwap(ch: Chunks, deviation_pct) -> tuple[Chunks, Column]:
    vwap = F.col(_named("vwap"))
    gap = (F.col("close") - vwap) / nonzero(vwap)
    return ch, _signed(gap < -deviation_pct, gap > deviation_pct)


def _ha(ch: Chunks, min_streak, strict=False) -> tuple[Chunks, Column]:
    ch = _once(ch, _green=(F.col(_named("ha_close")) > F.col(_named("ha_open"))).cast("int"))
    frame = ch.window.rowsBetween(-(min_streak - 1), 0)
    greens = _named("greens", min_streak)
    ch = _once(ch, **{greens: F.sum("_green").over(frame)})
    if strict:
        # As many reds in a row.
        reds = _named("reds", min_streak)
        ch = _once(ch, **{reds: F.sum(1 - F.col("_green")).over(frame)})
        return ch, _signed(F.col(greens) == min_streak, F.col(reds) == min_streak)
    # The literal red count restarts only where a candle repeats its colour, so it counts
    # the reds of an alternating run.  Colours alternate inside it: its length and the last
    # colour give the count, and 2 * min_streak + 1 rows always hold enough reds.
    reach, start = 2 * min_streak + 1, _named("run_start", min_streak)
    repeats = F.coalesce(F.col("_green") == F.lag("_green").over(ch.window), F.lit(False))
    ch = _once(ch, _repeats=repeats)
    frame = ch.window.rowsBetween(-(reach - 1), 0)
    ch = _once(ch, **{start: F.max(F.when(F.col("_repeats"), F.col("rn"))).over(frame)})
    length = F.coalesce(F.col("rn") - F.col(start) + 1, F.least(F.col("rn") + 1, F.lit(reach)))
    reds = F.floor((length + 1 - F.col("_green")) / 2)
    return ch, _signed(F.col(greens) == min_streak, reds >= min_streak)


@dataclass(frozen=True)
class Signal:
    """A signal: default parameters, the indicators it reads, its rule, and a parameter space."""

    name: str
    params: Mapping[str, object]
    needs: Callable[[Mapping], Sequence[Request]] = field(repr=False)
    build: Callable[..., tuple[Chunks, Column]] = field(repr=False)
    space: Mapping[str, tuple[float, float]]

    def lookback(self) -> int:
        return 2 * int(self.params.get("min_streak", 1)) + 2

    def with_params(self, **params) -> "Signal":
        return replace(self, params={**self.params, **params})

    def to_dict(self) -> dict:
        return {"name": self.name, "params": dict(self.params)}

    @staticmethod
    def from_dict(d: Mapping) -> "Signal":
        return SIGNALS[d["name"]].with_params(**d.get("params", {}))


# Defaults and parameter ranges are fixed values.
SIGNALS = {
    s.name: s
    for s in (
        Signal(
            "rsi_mean_reversion",
            {"rsi_period": 14, "oversold": 30, "overbought": 70},
            lambda p: [_request("rsi", period=p["rsi_period"]), _request("regime")],
            _rsi,
            {"rsi_period": (5, 30), "oversold": (15, 40), "overbought": (60, 85)},
        ),
        Signal(
            "macd_crossover",
            {"fast": 12, "slow": 26, "signal": 9},
            lambda p: [_request("macd_hist", fast=p["fast"], slow=p["slow"], signal=p["signal"])],
            _macd,
            {"fast": (5, 20), "slow": (15, 40), "signal": (5, 15)},
        ),
        Signal(
            "ema_trend",
            {"fast": 9, "medium": 21, "slow": 50},
            lambda p: [_request("ema", period=p[k]) for k in ("fast", "medium", "slow")],
            _ema,
            {"fast": (3, 15), "medium": (15, 30), "slow": (30, 100)},
        ),
        Signal(
            "vwap_bounce",
            {"deviation_pct": 0.01},
            lambda p: [_request("vwap")],
            _vwap,
            {"deviation_pct": (0.005, 0.03)},
        ),
        Signal(
            "heikin_ashi_streak",
            {"min_streak": 3},
            lambda p: [_request("ha_open"), _request("ha_close")],
            _ha,
            {"min_streak": (2, 6)},
        ),
    )
}


def resolve(signal: Signal | str) -> Signal:
    return SIGNALS[signal] if isinstance(signal, str) else signal


def needed(signals: Sequence[Signal]) -> list[Request]:
    """Indicator requests of several signals, each once."""
    return list({r.out: r for s in signals for r in s.needs(s.params)}.values())


def drop_helpers(ch: Chunks) -> Chunks:
    return ch.drop(*(c for c in ch.df.columns if c.startswith("_") and c not in ("_chunk", "_own")))


def signal_chunks(
    series: DataFrame, signal: Signal | str, keys: Sequence[str] = ("symbol",), after: int = 0
) -> Chunks:
    """Chunked rows with a ``signal`` column, and ``after`` look-ahead rows."""
    signal = resolve(signal)
    ch = indicator_chunks(series, needed([signal]), keys, before=signal.lookback(), after=after)
    ch, column = signal.build(ch, **signal.params)
    return drop_helpers(ch.add(signal=column.cast("int")))


def signal_on_slices(
    prepared: DataFrame, signal: Signal, keys: Sequence[str], after: int = 0
) -> Chunks:
    """The signal over re-keyed slices whose indicators were computed on the whole series."""
    ch, column = signal.build(chunked(prepared, keys, signal.lookback(), after), **signal.params)
    return drop_helpers(ch.add(signal=column.cast("int")))


def add_signal(series: DataFrame, signal: Signal | str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The series with an integer ``signal`` column."""
    return signal_chunks(series, signal, keys).own()
