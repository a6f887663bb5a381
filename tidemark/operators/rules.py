"""Rules as data: validation, fingerprints, and evaluation over bar series."""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import rolling
from tidemark.operators.indicators import REGISTRY, Request, indicator_chunks, known
from tidemark.plans.series import Chunks, Ewm

# Operators and rolling methods a rule may use.
THRESHOLD_OPS = ("lt", "gt", "lte", "gte", "eq", "ne")
CROSS_OPS = ("cross_above", "cross_below")
ROLLING_OPS = ("gt_rolling", "lt_rolling")
STREAK_OPS = ("streak_gte", "streak_lte")
OPS = THRESHOLD_OPS + CROSS_OPS + ROLLING_OPS + STREAK_OPS
ROLLING_METHODS = ("sma", "ema")
FIRST_ROW = 50

DOCUMENT = """
  name string,
  entry_conditions array<struct<
    indicator: string, op: string, value: variant, params: map<string, double>, rolling: string, period: int>>,
  exit struct<tp_pct: double, sl_pct: double, horizon_bars: int>
"""


# documents as a table ------------------------------------------------------------------


def parse_documents(docs: DataFrame, column: str = "document") -> DataFrame:
    """JSON rule documents as a struct column ``rule``."""
    return docs.withColumn("rule", F.from_json(column, DOCUMENT))


def read_documents(spark, path: str) -> DataFrame:
    """Rule documents from a folder of JSON files, one document per file."""
    return parse_documents(spark.read.text(path, wholetext=True).withColumnRenamed("value", "document"))


def _any(condition) -> Column:
    return F.coalesce(F.exists("rule.entry_conditions", condition), F.lit(False))


def validate(rules: DataFrame) -> DataFrame:
    """Add ``errors`` (array of messages) and ``valid``."""

    def rolls(c):
        return F.coalesce(c["op"].isin(*ROLLING_OPS), F.lit(False))

    kind = lambda c: F.schema_of_variant(c["value"])
    checks = {
        "missing name": F.col("rule.name").isNull(),
        "missing entry_conditions": F.col("rule.entry_conditions").isNull(),
        "condition missing indicator": _any(lambda c: c["indicator"].isNull()),
        "condition missing op": _any(lambda c: c["op"].isNull()),
        "invalid op": _any(lambda c: ~c["op"].isin(*OPS)),
        "rolling op needs a method": _any(lambda c: rolls(c) & c["rolling"].isNull()),
        "invalid rolling method": _any(lambda c: rolls(c) & ~c["rolling"].isin(*ROLLING_METHODS)),
        "rolling op needs a period": _any(lambda c: rolls(c) & c["period"].isNull()),
        "value is not a number": _any(lambda c: ~kind(c).rlike("^(BIGINT|DOUBLE|DECIMAL.*|BOOLEAN|VOID)$")),
    }
    found = F.array_compact(F.array(*(F.when(c, F.lit(text)) for text, c in checks.items())))
    return rules.withColumn("errors", found).withColumn("valid", F.size("errors") == 0)


def fingerprint(conditions: str = "rule.entry_conditions") -> Column:
    """First 12 hex digits of the md5 of the sorted ``(indicator, op)`` pairs as a JSON list."""
    pairs = F.array_sort(
        F.transform(
            conditions,
            lambda c: F.struct(
                F.coalesce(c["indicator"], F.lit("?")).alias("i"), F.coalesce(c["op"], F.lit("?")).alias("o")
            ),
        )
    )
    text = F.transform(pairs, lambda p: F.format_string('["%s", "%s"]', p["i"], p["o"]))
    return F.substring(F.md5(F.concat(F.lit("["), F.concat_ws(", ", text), F.lit("]"))), 1, 12)


def dedup(rules: DataFrame, order: Sequence[str], seen: DataFrame | None = None, key: str = "fp") -> DataFrame:
    """First rule of each fingerprint that no ``seen`` table holds.

    Spark prunes to one row per key and task before the shuffle (window group limit), so
    a fingerprint shared by most rules costs no more than a rare one.
    """
    first = Window.partitionBy(key).orderBy(*order)
    fresh = rules.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")
    return fresh if seen is None else fresh.join(seen.select(key).distinct(), key, "left_anti")


# evaluation over bars ------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    indicator: str
    op: str
    value: float | None = None
    params: Mapping[str, float] = field(default_factory=dict)
    rolling: str | None = None
    period: int | None = None


@dataclass(frozen=True)
class Rule:
    rule_id: str
    conditions: tuple[Condition, ...]
    tp: float = 0.05
    sl: float = 0.02
    horizon: int = 48

    @staticmethod
    def from_document(d: Mapping) -> "Rule":
        end = d.get("exit", {})
        return Rule(
            d["name"],
            tuple(Condition(**c) for c in d["entry_conditions"]),
            end.get("tp_pct", 0.05),
            end.get("sl_pct", 0.02),
            end.get("horizon_bars", 48),
        )


def _request(c: Condition) -> Request:
    defaults = REGISTRY[c.indicator][0]
    params = {k: int(v) if isinstance(defaults[k], int) else v for k, v in c.params.items() if k in defaults}
    tag = "_".join([c.indicator, *(f"{k}{v}" for k, v in sorted(params.items()))])
    return Request(f"_i_{tag}", c.indicator, params)


def _streak(c: Condition) -> tuple[int, int]:
    """Rows needed in a row, and how far the count may look back."""
    return max(0, math.ceil(c.value or 3)), int(c.period or 5)


def _lookback(c: Condition) -> int:
    if c.op in CROSS_OPS:
        return 1
    if c.op in ROLLING_OPS:
        return c.period
    return _streak(c)[0] if c.op in STREAK_OPS else 0


def condition_chunks(
    series: DataFrame, conditions: Sequence[Condition], keys: Sequence[str] = ("symbol",), after: int = 0
) -> tuple[Chunks, list[Column]]:
    """Chunked rows, and one never-NULL boolean Column per condition.

    Equal indicators are computed once; an unknown indicator counts as constant 0.
    """
    requests = {c: _request(c) for c in set(map(_freeze, conditions)) if known(c.indicator)}
    wanted = list({r.out: r for r in requests.values()}.values())
    ch = indicator_chunks(series, wanted, keys, before=max(map(_lookback, conditions), default=0), after=after)
    w = ch.window

    def source(c: Condition) -> str | None:
        return requests[_freeze(c)].out if known(c.indicator) else None

    def value(c: Condition) -> Column:
        return F.col(source(c)) if source(c) else F.lit(0.0)

    helpers, smooth = {}, {}
    for c in conditions:
        name = source(c) or "_zero"
        if c.op in CROSS_OPS:
            helpers[f"{name}_prev"] = F.lag(value(c)).over(w)
        elif c.op in ROLLING_OPS and c.rolling == "sma":
            helpers[f"{name}_sma{c.period}"] = rolling(F.avg, value(c), w, c.period)
        elif c.op in ROLLING_OPS:
            smooth[f"{name}_ema{c.period}"] = Ewm(f"{name}_ema{c.period}", name, 2.0 / (c.period + 1), c.period)
        elif c.op in STREAK_OPS and _streak(c)[0] > 0:
            need, up = _streak(c)[0], c.op == "streak_gte"
            hit = F.coalesce((value(c) > 0) if up else (value(c) < 0), F.lit(False)).cast("int")
            helpers[f"{name}_{c.op}{need}"] = F.sum(hit).over(w.rowsBetween(-(need - 1), 0))
    if any(not source(c) and c.op in ROLLING_OPS for c in conditions):
        ch = ch.add(_zero=F.lit(0.0))
    if helpers:
        ch = ch.add(**helpers)
    ch = ch.scan(*smooth.values())

    def holds(c: Condition) -> Column:
        x, name = value(c), source(c) or "_zero"
        if c.op in THRESHOLD_OPS:
            v = F.lit(float(c.value))
            test = {"lt": x < v, "gt": x > v, "lte": x <= v, "gte": x >= v, "eq": x == v, "ne": x != v}[c.op]
        elif c.op in CROSS_OPS:
            prev, v = F.col(f"{name}_prev"), F.lit(float(c.value))
            test = ((prev <= v) & (x > v)) if c.op == "cross_above" else ((prev >= v) & (x < v))
        elif c.op in ROLLING_OPS:
            mean = F.col(f"{name}_{c.rolling}{c.period}")
            test = x > mean if c.op == "gt_rolling" else x < mean
        else:
            need, reach = _streak(c)
            if need == 0:
                test = x.isNotNull()
            elif need > reach:
                test = F.lit(False)
            else:
                test = F.col(f"{name}_{c.op}{need}") == need
        return F.coalesce(test, F.lit(False))

    return ch, [holds(c) for c in conditions]


class _Key(tuple):
    indicator = property(lambda self: self[0])
    params = property(lambda self: dict(self[1]))


def _freeze(c) -> _Key:
    return _Key((c.indicator, tuple(sorted(dict(c.params).items()))))


def rule_chunks(
    series: DataFrame, rules: Sequence[Rule], keys: Sequence[str] = ("symbol",), after: int = 0
) -> tuple[Chunks, list[Column]]:
    """Chunked rows, and one boolean Column per rule (all conditions, from row 50 on)."""
    flat = [c for r in rules for c in r.conditions]
    ch, holds = condition_chunks(series, flat, keys, after)
    out, at = [], 0
    for r in rules:
        passed = F.col("rn") >= FIRST_ROW
        for column in holds[at : at + len(r.conditions)]:
            passed = passed & column
        at += len(r.conditions)
        out.append(passed)
    return ch, out


def evaluate(series: DataFrame, rule: Rule, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The series with ``signal`` 1 where all conditions of the rule hold, else 0."""
    ch, (passed,) = rule_chunks(series, [rule], keys)
    ch = ch.add(signal=passed.cast("int"))
    return ch.own().select(*series.columns, "signal")


def fired(series: DataFrame, rules: Sequence[Rule], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One row per rule and bar on which it fires, all rules in one pass over the bars.

    Rows carry the rule's exit settings and the following bar's open, and leave out
    entries without a full horizon behind them.
    """
    ch, passed = rule_chunks(series, rules, keys, after=1)
    ch = ch.add(entry_price=F.lead("open").over(ch.window), entry_ts=F.lead("ts").over(ch.window))
    hits = [
        F.when(
            p & (F.col("rn") + 1 + r.horizon < F.col("n")),
            F.struct(
                F.lit(r.rule_id).alias("rule_id"),
                F.lit(float(r.tp)).alias("tp"),
                F.lit(float(r.sl)).alias("sl"),
                F.lit(r.horizon).alias("horizon"),
            ),
        )
        for r, p in zip(rules, passed)
    ]
    rows = ch.own().select(
        *keys, "rn", "n", F.lit(1).alias("signal"), "entry_price", "entry_ts",
        F.explode(F.array_compact(F.array(*hits))).alias("_hit"),
    )
    return rows.select("_hit.*", *keys, "rn", "n", "signal", "entry_price", "entry_ts")


# random candidates ----------------------------------------------------------------------

# What random candidate rules are drawn from.
CANDIDATE_VALUES = {
    "rsi": list(range(20, 80, 5)),
    "regime": [0],
    "volume": [round(0.1 * v, 1) for v in range(5, 50, 5)],
    "adx": list(range(15, 50, 5)),
    "atr": [round(0.1 * v, 1) for v in range(10, 100, 10)],
    "macd": list(range(-10, 11, 2)),
    "ema": list(range(5, 100, 10)),
}
CANDIDATE_EXITS = [
    (0.04, 0.015, 48),
    (0.05, 0.02, 48),
    (0.03, 0.01, 24),
    (0.04, 0.01, 24),
    (0.06, 0.02, 48),
]


def random_rules(count: int, seed: int, values: Mapping[str, Iterable] | None = None) -> list[Rule]:
    """Candidate rules of one to three lt/gt conditions, reproducible by seed."""
    values = {k: list(v) for k, v in (values or CANDIDATE_VALUES).items()}
    rng = random.Random(seed)
    out = []
    for i in range(count):
        picked = rng.sample(sorted(values), rng.randint(1, 3))
        conditions = tuple(Condition(p, rng.choice(["lt", "gt"]), float(rng.choice(values[p]))) for p in picked)
        out.append(Rule(f"rule_{i}", conditions, *rng.choice(CANDIDATE_EXITS)))
    return out
