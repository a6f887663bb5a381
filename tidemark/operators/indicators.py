"""Technical indicators over indexed bar series.

A request names an indicator and its parameters.  All requested indicators share one
chunked pass: look-back windows run as Spark window functions, cumulative ones as
running sums, exponentially weighted ones as decayed sums with a carry.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.numbers import nonzero, rolling
from tidemark.plans.series import Chunks, Ewm, Run, chunked, underflow_rows

Builder = Callable[[WindowSpec], Column]
BAR_COLUMNS = ("open", "high", "low", "close", "volume")


@dataclass(frozen=True)
class Request:
    out: str
    name: str
    params: Mapping[str, object] = field(default_factory=dict)


class _Pass:
    """What one chunked pass must compute; equal helper columns are shared by name."""

    def __init__(self):
        self.lookback = self.halo = 0
        self.levels: list[dict[str, Builder]] = [{} for _ in range(5)]
        self.scans: dict[str, Run | Ewm] = {}
        self.steps: dict[str, Callable[[pd.DataFrame], pd.Series]] = {}
        self.step_reads: set[str] = set()
        self.bound: dict[str, Column] = {}
        self.outputs: dict[str, Column] = {}

    def rows(self, count: int) -> None:
        """Look-back of window columns."""
        self.lookback = max(self.lookback, count)

    def rows_after(self, count: int) -> None:
        """Look-back of what is computed from finished window and scan columns."""
        self.halo = max(self.halo, count)

    def at(self, level: int, name: str, build: Builder) -> str:
        self.levels[level].setdefault(name, build)
        return name

    def scan(self, spec: Run | Ewm) -> str:
        self.scans.setdefault(spec.out, spec)
        return spec.out

    def step(self, name: str, fn: Callable[[pd.DataFrame], pd.Series], *reads: str) -> str:
        self.steps.setdefault(name, fn)
        self.step_reads.update(reads)
        return name

    def bind(self, column: Column) -> str:
        name = f"_bound{len(self.bound)}"
        self.bound[name] = column
        return name

    # shared helpers -----------------------------------------------------------------

    def lag(self, column: str, rows: int = 1) -> str:
        self.rows(rows)
        return self.at(0, f"_lag{rows}_{column}", lambda w: F.lag(column, rows).over(w))

    def delta(self) -> Column:
        return F.col("close") - F.col(self.lag("close"))

    def ema(self, column: str, period: int) -> str:
        return self.scan(Ewm(f"_ema_{column}_{period}", column, 2.0 / (period + 1), period))

    def true_range(self) -> str:
        prev = F.col(self.lag("close"))
        high, low = F.col("high"), F.col("low")
        tr = F.greatest(F.abs(high - low), F.abs(high - prev), F.abs(low - prev))
        return self.at(1, "_tr", lambda w: tr)

    def mean(self, level: int, column: str, period: int) -> str:
        return self.at(level, f"_mean{period}_{column}", lambda w: rolling(F.avg, F.col(column), w, period))

    def atr(self, period: int) -> str:
        self.rows(period)
        return self.mean(2, self.true_range(), period)

    def adx(self, period: int) -> str:
        self.rows(2 * period)
        up = F.col("high") - F.col(self.lag("high"))
        down = F.col(self.lag("low")) - F.col("low")
        none = F.lit(0.0)
        plus = F.when((up > down) & (up > 0), up).when(up.isNotNull() & down.isNotNull(), none)
        minus = F.when((down > up) & (down > 0), down).when(up.isNotNull() & down.isNotNull(), none)
        self.at(1, "_plus", lambda w: plus)
        self.at(1, "_minus", lambda w: minus)
        span = nonzero(F.col(self.atr(period)))
        pdi = 100 * F.col(self.mean(2, "_plus", period)) / span
        mdi = 100 * F.col(self.mean(2, "_minus", period)) / span
        dx = self.at(3, f"_dx{period}", lambda w: F.abs(pdi - mdi) / nonzero(pdi + mdi) * 100)
        return self.mean(4, dx, period)

    def macd(self, fast: int, slow: int, signal: int) -> tuple[Column, Column]:
        a, b = self.ema("close", fast), self.ema("close", slow)
        alpha = 2.0 / (signal + 1)
        # The halo is long enough for older terms of the second smoothing to vanish.
        self.rows_after(underflow_rows(alpha) + slow)
        line = F.col(a) - F.col(b)
        smooth = self.step(
            f"_signal_{fast}_{slow}_{signal}",
            lambda pdf: (pdf[a] - pdf[b]).ewm(alpha=alpha, min_periods=signal).mean(),
        )
        return line, F.col(smooth)

    def _spent(self) -> list[str]:
        """Helper columns nothing reads after the window levels; they need not reach the Python workers."""
        later = " ".join(str(c) for c in (*self.outputs.values(), *self.bound.values()))
        read = {s.value for s in self.scans.values()} | self.step_reads
        return [name for level in self.levels for name in level if name not in read and name not in later]

    def run(self, series: DataFrame, keys: Sequence[str], before: int, after: int) -> Chunks:
        ch = chunked(series, keys, self.lookback + self.halo + before, after)
        for level in self.levels:
            if level:
                ch = ch.add(**{name: build(ch.window) for name, build in level.items()})
        ch = ch.drop(*self._spent()).trim(self.lookback)
        steps = self.steps
        then = None
        if steps:
            def then(pdf):
                return pdf.assign(**{name: fn(pdf) for name, fn in steps.items()})
        ch = ch.scan(*self.scans.values(), then=then, then_schema=", ".join(f"{s} double" for s in steps))
        for name, column in self.bound.items():
            ch = ch.add(**{name: column})
        keep = [c for c in series.columns if c not in self.outputs]
        outputs = [c.alias(name) for name, c in self.outputs.items()]
        return Chunks(ch.df.select(*keep, *outputs, "_chunk", "_own"), ch.keys, ch.size, ch.before)


def _ha_close() -> Column:
    return (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4


def _ha_open(p: _Pass) -> Column:
    # open'(t) = (open'(t-1) + close'(t-1)) / 2 unrolled: halving sum of close' seeded by the first open.
    seed = _ha_close() + F.when(F.col("rn") == 0, F.col("open")).otherwise(F.lit(0.0))
    p.at(0, "_ha_seed", lambda w: seed)
    return F.col(p.scan(Ewm("_ha_sum", "_ha_seed", 0.5, how="sum"))) - _ha_close()


def _rsi(p: _Pass, period: int = 14) -> Column:
    delta = p.delta()
    zero = F.lit(0.0)
    p.at(1, "_gain", lambda w: F.when(delta.isNotNull(), F.greatest(delta, zero)))
    p.at(1, "_loss", lambda w: F.when(delta.isNotNull(), F.greatest(-delta, zero)))
    gain = p.scan(Ewm(f"_gain_{period}", "_gain", 1.0 / period, period))
    loss = p.scan(Ewm(f"_loss_{period}", "_loss", 1.0 / period, period))
    return 100 - 100 / (1 + F.col(gain) / nonzero(F.col(loss)))


def _vwap(p: _Pass) -> Column:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    p.at(0, "_pv", lambda w: typical * F.col("volume"))
    return F.col(p.scan(Run("_sum_pv", "_pv"))) / nonzero(F.col(p.scan(Run("_sum_volume", "volume"))))


def _obi(p: _Pass) -> Column:
    delta = p.delta()
    p.at(1, "_flow", lambda w: F.coalesce(F.signum(delta) * F.col("volume"), F.lit(0.0)))
    return F.col(p.scan(Run("_obi", "_flow")))


def _regime(p: _Pass) -> Column:
    """0 ranging, 1 trending up, 2 trending down, 3 volatile."""
    atr = p.atr(14)
    p.rows_after(100)
    ema = p.ema("close", 50)
    # Wide windows slide in linear time next to the average they need.
    usual = p.step("_usual_atr", lambda pdf: pdf[atr].rolling(100).mean(), atr)
    share = F.col(p.step("_above_50", lambda pdf: (pdf["close"] > pdf[ema]).astype(float).rolling(50).mean()))
    spike = F.col(atr) > F.col(usual) * 1.5
    trending = F.col(p.adx(14)) >= 20
    return F.when(trending & (share < 0.4), 2).when(trending & (share > 0.6), 1).when(spike, 3).otherwise(0)


def _roll(fn) -> Callable:
    def build(p: _Pass, column: str = "close", period: int = 20) -> Column:
        p.rows(period)
        name = f"_{fn.__name__}{period}_{column}"
        return F.col(p.at(0, name, lambda w: rolling(fn, F.col(column), w, period)))

    return build


def _shift(p: _Pass, column: str = "close", period: int = 1) -> Column:
    return F.col(p.lag(column, period))


def _diff(p: _Pass, column: str = "close", period: int = 1) -> Column:
    return F.col(column) - F.col(p.lag(column, period))


def _pct_change(p: _Pass, column: str = "close", period: int = 1) -> Column:
    before = F.col(p.lag(column, period))
    return F.col(column) / nonzero(before) - 1


def _derived(expression: str, inputs: Mapping[str, tuple[str, dict]]) -> Callable:
    """Builder of a Spark SQL expression; ``{key}`` stands for a parameter or a named input."""

    def fill(value, params):
        return params[value[1:-1]] if isinstance(value, str) and value[:1] == "{" else value

    def build(p: _Pass, **params) -> Column:
        text = expression
        for alias, (name, wanted) in inputs.items():
            given = {k: fill(v, params) for k, v in wanted.items()}
            text = text.replace("{" + alias + "}", p.bind(_build(p, name, given)))
        for key, value in params.items():
            text = text.replace("{" + key + "}", str(value))
        return F.expr(text)

    return build


# name -> (default parameters, builder)
REGISTRY: dict[str, tuple[dict, Callable]] = {
    **{c: ({}, lambda p, c=c: F.col(c)) for c in BAR_COLUMNS},
    "rsi": ({"period": 14}, _rsi),
    "ema": ({"period": 20}, lambda p, period, column="close": F.col(p.ema(column, period))),
    "macd": ({"fast": 12, "slow": 26, "signal": 9},
             lambda p, fast, slow, signal: F.col(p.ema("close", fast)) - F.col(p.ema("close", slow))),
    "macd_signal": ({"fast": 12, "slow": 26, "signal": 9}, lambda p, **k: p.macd(**k)[1]),
    "macd_hist": ({"fast": 12, "slow": 26, "signal": 9}, lambda p, **k: (lambda m: m[0] - m[1])(p.macd(**k))),
    "vwap": ({}, _vwap),
    "cum_volume": ({}, lambda p: F.col(p.scan(Run("_sum_volume", "volume")))),
    "obi": ({}, _obi),
    "atr": ({"period": 14}, lambda p, period: F.col(p.atr(period))),
    "adx": ({"period": 14}, lambda p, period: F.col(p.adx(period))),
    "regime": ({}, _regime),
    "ha_close": ({}, lambda p: _ha_close()),
    "ha_open": ({}, _ha_open),
    "ha_high": ({}, lambda p: F.greatest("high", "low", "close", _ha_open(p))),
    "ha_low": ({}, lambda p: F.least("high", "low", "close", _ha_open(p))),
    "sma": ({"column": "close", "period": 20}, _roll(F.avg)),
    "std": ({"column": "close", "period": 20}, _roll(F.stddev_samp)),
    "max_roll": ({"column": "close", "period": 20}, _roll(F.max)),
    "min_roll": ({"column": "close", "period": 20}, _roll(F.min)),
    "shift": ({"column": "close", "period": 1}, _shift),
    "diff": ({"column": "close", "period": 1}, _diff),
    "pct_change": ({"column": "close", "period": 1}, _pct_change),
}

# The standard feature set.
ALL = (
    Request("rsi_14", "rsi", {"period": 14}),
    Request("macd", "macd"),
    Request("macd_signal", "macd_signal"),
    Request("macd_hist", "macd_hist"),
    Request("ema_9", "ema", {"period": 9}),
    Request("ema_21", "ema", {"period": 21}),
    Request("ema_50", "ema", {"period": 50}),
    Request("vwap", "vwap"),
    Request("obi", "obi"),
    Request("ha_open", "ha_open"),
    Request("ha_high", "ha_high"),
    Request("ha_low", "ha_low"),
    Request("ha_close", "ha_close"),
    Request("atr_14", "atr", {"period": 14}),
    Request("adx_14", "adx", {"period": 14}),
    Request("regime", "regime"),
)


def known(name: str) -> bool:
    return name in REGISTRY


def _build(p: _Pass, name: str, params: Mapping[str, object]):
    if name not in REGISTRY:
        raise ValueError(f"unknown indicator {name!r}; known: {', '.join(sorted(REGISTRY))}")
    defaults, build = REGISTRY[name]
    return build(p, **{**defaults, **params})


def register(
    name: str, expression: str, inputs: Mapping[str, tuple[str, dict]] | None = None, params: Mapping | None = None
) -> None:
    """Add a derived indicator: a Spark SQL expression over bar columns and named inputs.

    ``inputs`` maps a name to ``(indicator, parameters)``; ``{name}`` in the expression
    stands for that input and ``{key}`` for a call parameter, as in
    ``register("ma_gap", "(close - {ma}) / close", {"ma": ("sma", {"period": "{period}"})}, {"period": 20})``.
    """
    if name in REGISTRY:
        raise ValueError(f"indicator {name!r} exists already")
    REGISTRY[name] = (dict(params or {}), _derived(expression, inputs or {}))


def indicator_chunks(
    series: DataFrame,
    requests: Sequence[Request],
    keys: Sequence[str] = ("symbol",),
    before: int = 0,
    after: int = 0,
) -> Chunks:
    """Indicators of ``requests`` as columns, still chunked with at least the given halo.

    Rows in the first ``before`` positions of a halo only serve look-backs of this pass.
    """
    p = _Pass()
    for r in requests:
        p.outputs[r.out] = _build(p, r.name, r.params)
    return p.run(series, keys, before, after)


def add_indicators(series: DataFrame, requests: Sequence[Request], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return indicator_chunks(series, requests, keys).own()


def add_all(series: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return add_indicators(series, ALL, keys)


def whole_series(
    df: DataFrame, source: DataFrame | None = None, keys: Sequence[str] = ("symbol",), **aggregates: Column
) -> DataFrame:
    """Whole-series aggregates of each key beside every row.

    Aggregates of plain bar columns are cheaper from the ``source`` the rows were made from.
    """
    totals = (df if source is None else source).groupBy(*keys).agg(*(c.alias(name) for name, c in aggregates.items()))
    return df.join(totals, list(keys))
