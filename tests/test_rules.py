import hashlib
import json
import math
import time

import pandas as pd
import pytest
from helpers import collect, ema, expected_indicators, frame, make_bars
from pyspark.sql import functions as F

from tidemark.operators import rules
from tidemark.operators.rules import Condition, Rule
from tidemark.plans import research, rulebook
from tidemark.plans.series import index_rows
from tidemark.sources import results


def holds(c: Condition, x: pd.Series, i: int) -> bool:
    """One condition at one row, read off its definition."""
    v = x.iloc[i]
    if pd.isna(v):
        return False
    plain = {"lt": v < c.value, "gt": v > c.value, "lte": v <= c.value, "gte": v >= c.value, "eq": v == c.value, "ne": v != c.value} if c.value is not None else {}
    if c.op in plain and c.op in rules.THRESHOLD_OPS:
        return bool(plain[c.op])
    if c.op in rules.CROSS_OPS:
        p = x.iloc[i - 1] if i else math.nan
        return bool(p <= c.value < v) if c.op == "cross_above" else bool(p >= c.value > v)
    if c.op in rules.ROLLING_OPS:
        m = (x.rolling(c.period).mean() if c.rolling == "sma" else ema(x, c.period)).iloc[i]
        return bool(v > m) if c.op == "gt_rolling" else bool(v < m)
    count = 0
    for j in range(i, max(-1, i - (c.period or 5)), -1):
        if not (x.iloc[j] > 0 if c.op == "streak_gte" else x.iloc[j] < 0):
            break
        count += 1
    return count >= (c.value or 3)


CONDITIONS = [
    Condition("rsi", "lt", 48), Condition("close", "gte", 100.0), Condition("regime", "eq", 0), Condition("regime", "ne", 0),
    Condition("rsi", "cross_above", 50), Condition("close", "cross_below", 100.0),
    Condition("close", "gt_rolling", rolling="sma", period=10), Condition("rsi", "lt_rolling", rolling="ema", period=9),
    Condition("macd_hist", "streak_gte"), Condition("macd_hist", "streak_lte", 2.5, period=4), Condition("macd", "streak_gte", 7, period=6),
    Condition("nosuch", "lt", 1), Condition("nosuch", "gt_rolling", rolling="sma", period=3),
]


def test_every_operator_equals_its_definition(spark, small_chunks):
    pdf = make_bars(400, seed=13, step=0.6)
    i = expected_indicators(pdf)
    source = {"rsi": i["rsi_14"], "close": pdf["close"], "regime": i["regime"], "macd_hist": i["macd_hist"], "macd": i["macd"]}
    ch, columns = rules.condition_chunks(index_rows(frame(spark, pdf)), CONDITIONS)
    got = collect(ch.add(**{f"c{k}": c for k, c in enumerate(columns)}).own(), "ts")
    for k, c in enumerate(CONDITIONS):
        x = source.get(c.indicator, pd.Series(0.0, index=pdf.index))
        want = [holds(c, x, r) for r in range(len(pdf))]
        assert got[f"c{k}"].tolist() == want, c


def test_rules_start_at_row_50_and_need_all_conditions(spark):
    series = index_rows(frame(spark, pd.concat([make_bars(120), make_bars(40, "short")])))
    got = collect(rules.evaluate(series, Rule("r", (Condition("volume", "gte", 0), Condition("nosuch", "lt", 1)))), "symbol", "ts")
    assert got["signal"].tolist() == [0] * 50 + [1] * 70 + [0] * 40
    none = rules.evaluate(series, Rule("r", (Condition("volume", "gte", 0), Condition("nosuch", "gt", 1))))
    assert none.agg(F.sum("signal")).first()[0] == 0


def documents(spark, *docs):
    return rules.parse_documents(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "rule_key long, document string"))


GOOD = {"name": "a", "entry_conditions": [{"indicator": "rsi", "op": "lt", "value": 30}], "exit": {"tp_pct": 0.04}}


def with_condition(**changes):
    return {**GOOD, "entry_conditions": [{**GOOD["entry_conditions"][0], **changes}]}


def test_validation(spark):
    cases = [
        (GOOD, []),
        ({k: v for k, v in GOOD.items() if k != "name"}, ["missing name"]),
        ({"name": "x"}, ["missing entry_conditions"]),
        ({"name": "x", "entry_conditions": [{"op": "lt"}]}, ["condition missing indicator"]),
        ({"name": "x", "entry_conditions": [{"indicator": "rsi"}]}, ["condition missing op"]),
        (with_condition(op="between"), ["invalid op"]),
        (with_condition(op="gt_rolling"), ["rolling op needs a method", "rolling op needs a period"]),
        (with_condition(op="gt_rolling", rolling="wma", period=3), ["invalid rolling method"]),
        (with_condition(op="lt_rolling", rolling="sma", period=3), []),
        (with_condition(value="30"), ["value is not a number"]),
        (with_condition(value=[1]), ["value is not a number"]),
        (with_condition(value=None), []),
        (with_condition(value=0.5), []),
    ]
    got = collect(rules.validate(documents(spark, *(d for d, _ in cases))).select("rule_key", "errors", "valid"), "rule_key")
    assert [list(e) for e in got["errors"]] == [e for _, e in cases]
    assert got["valid"].tolist() == [not e for _, e in cases]


def test_fingerprint_ignores_values_and_order(spark):
    two = {"name": "b", "entry_conditions": [{"indicator": "rsi", "op": "gt", "value": 1}, {"indicator": "adx", "op": "lt"}]}
    swapped = {"name": "c", "entry_conditions": two["entry_conditions"][::-1]}
    holes = {"name": "d", "entry_conditions": [{"op": "lt"}]}
    got = collect(documents(spark, two, swapped, holes, {"name": "e"}).select("rule_key", rules.fingerprint().alias("fp")), "rule_key")["fp"]

    def expected(pairs):
        return hashlib.md5(json.dumps(sorted(pairs)).encode()).hexdigest()[:12]

    assert got.tolist() == [expected([("adx", "lt"), ("rsi", "gt")])] * 2 + [expected([("?", "lt")]), expected([])]


def test_dedup_prunes_before_the_shuffle(spark):
    rows = spark.range(1000).select(F.col("id").alias("rule_key"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("fp"))
    seen = spark.createDataFrame([("1",), ("1",), ("2",)], "fp string")
    fresh = rules.dedup(rows, ["rule_key"], seen)
    assert "WindowGroupLimit" in fresh._jdf.queryExecution().executedPlan().toString()
    got = fresh.toPandas()
    assert got.loc[got["fp"] == "hot", "rule_key"].tolist() == [0]
    assert len(got) == 1 + 666 - 2


def test_sweep_equals_single_rules(spark, small_chunks):
    series = index_rows(frame(spark, make_bars(500, seed=17, step=0.7)))
    many = rules.random_rules(6, 3, {"rsi": [40, 60], "volume": [10, 30], "macd": [-1, 0, 1]})
    assert many == rules.random_rules(6, 3, {"rsi": [40, 60], "volume": [10, 30], "macd": [-1, 0, 1]})
    together = research.sweep(series, many).toPandas()
    for r in many:
        alone = research.sweep(series, [r]).toPandas()
        mine = together[together["rule_id"] == r.rule_id]
        assert sorted(alone["rn"]) == sorted(mine["rn"]), r
        assert alone["net_raw"].sum() == pytest.approx(mine["net_raw"].sum())
    read = Rule.from_document(json.loads(json.dumps(GOOD)))
    assert (read.tp, read.sl, read.horizon) == (0.04, 0.02, 48)


# rules as a table ---------------------------------------------------------------------------


def stored(spark, rule_list):
    """Rule objects as a table of parsed documents."""
    docs = [
        {
            "name": r.rule_id,
            "entry_conditions": [{k: v for k, v in {"indicator": c.indicator, "op": c.op, "value": c.value, "params": dict(c.params) or None, "rolling": c.rolling, "period": c.period}.items() if v is not None} for c in r.conditions],
            "exit": {"tp_pct": r.tp, "sl_pct": r.sl, "horizon_bars": r.horizon},
        }
        for r in rule_list
    ]
    return rulebook.rule_table(documents(spark, *docs).withColumn("name", F.col("rule.name")))


MIXED = [
    *(Rule(f"one_{i}", (c,), 0.02, 0.01, 12) for i, c in enumerate(CONDITIONS)),
    Rule("two", (CONDITIONS[0], CONDITIONS[5]), 0.01, 0.01, 5),
    Rule("twice", (CONDITIONS[1], CONDITIONS[1]), 0.03, 0.01, 30),
    Rule("short_rsi", (Condition("rsi", "lt", 40, {"period": 5, "nosuch": 3.0}),), 0.02, 0.01, 12),
    Rule("long_rsi", (Condition("rsi", "lt", 40),), 0.02, 0.01, 12),
    Rule("none", (Condition("close", "lt", -1.0), CONDITIONS[0])),
]


@pytest.mark.parametrize("limits", [(24, 2048, 4096), (2, 3, 64)])
def test_a_table_of_rules_fires_as_single_rules_do(spark, small_chunks, monkeypatch, limits):
    for name, value in zip(("OPERANDS", "CONDITIONS", "SPAN"), limits):
        monkeypatch.setattr(rulebook, name, value)
    series = index_rows(frame(spark, pd.concat([make_bars(330, seed=13, step=0.6), make_bars(90, "b", 5)])))
    table = stored(spark, MIXED)
    got = rulebook.fired(series, table).toPandas()
    want = rules.fired(series, MIXED).toPandas()
    inside = got.merge(series.groupBy("symbol").agg(F.max("n").alias("n")).toPandas())
    inside = inside[inside["rn"] + 1 + inside["horizon"] < inside["n"]]
    for r in MIXED:
        a, b = (sorted(map(tuple, x.loc[x["rule_id"] == r.rule_id, ["symbol", "rn"]].values)) for x in (inside, want))
        assert a == b, r
    assert not got.duplicated(["rule_id", "symbol", "rn"]).any()


def test_a_table_of_rules_sweeps_as_a_list_does(spark, small_chunks):
    series = index_rows(frame(spark, make_bars(420, seed=17, step=0.7)))
    many = rules.random_rules(9, 3, {"rsi": [40, 60], "volume": [10, 30], "macd": [-1, 0, 1]})
    columns = ["rule_id", "symbol", "rn", "exit_reason", "horizon_bars", "net_pnl"]
    got = rulebook.sweep(series, stored(spark, many)).select(*columns).toPandas()
    want = research.sweep(series, many).select(*columns).toPandas()
    order = ["rule_id", "rn"]
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True))
    screened = rulebook.screened_sweep(series, stored(spark, many)).toPandas().sort_values("rule_id", ignore_index=True)
    old = research.screened_sweep(series, many).toPandas().sort_values("rule_id", ignore_index=True)
    assert len(old) and screened.equals(old[screened.columns])
    none = stored(spark, many).limit(0)
    assert rulebook.sweep(series, none).count() == 0


def test_passes_are_bounded_and_thousands_of_rules_plan_quickly(spark, monkeypatch):
    monkeypatch.setattr(rulebook, "CONDITIONS", 1000)
    many = spark.range(5000).select(
        F.col("id").cast("string").alias("rule_id"), F.lit(0.01).alias("tp"), F.lit(0.01).alias("sl"), F.lit(12).alias("horizon"),
        F.expr("""transform(sequence(0, cast(id % 3 as int)), j -> named_struct('indicator', element_at(array('rsi', 'close', 'volume'), j + 1), 'op', if(id % 2 = 0, 'lt', 'gt'),
                  'value', parse_json(cast(id / 50 as string)), 'params', cast(NULL as map<string, double>), 'rolling', cast(NULL as string), 'period', cast(NULL as int)))""").alias("conditions"),
    )
    start = time.time()
    made = list(rulebook.passes(rulebook.conditions_of(many)))
    assert sum(len(p.conditions) for p in made) == rulebook.conditions_of(many).select("condition_id").distinct().count()
    assert all(len(p.conditions) <= 1000 and len({r["operand"] for r in p.conditions}) <= rulebook.OPERANDS for p in made)
    assert time.time() - start < 60
    series = index_rows(frame(spark, make_bars(300, seed=1)))
    assert rulebook.fired(series, many).select("rule_id").distinct().count() > 1000


def test_documents_are_stored_read_and_deduplicated(spark, tmp_path):
    docs = [GOOD, {**GOOD, "name": "b"}, with_condition(op="between"), {**with_condition(indicator="adx"), "name": "c"}, {**with_condition(indicator="macd"), "name": "d"}]
    path, log = str(tmp_path / "docs"), str(tmp_path / "log")
    table = documents(spark, *docs)
    results.write_documents(table.filter("rule_key < 3"), path)
    results.write_documents(table.filter("rule_key >= 3"), path)
    results.record_fingerprints(table.filter("rule_key = 4").select(rules.fingerprint().alias("fp"), F.col("rule.name").alias("name")), log)
    tried, rejected = rulebook.load(spark, path, results.seen_fingerprints(spark, log))
    assert sorted(r["name"] for r in tried.collect()) == ["a", "c"]  # b is a copy of a, d was tried before
    assert [r["errors"] for r in rejected.collect()] == [["invalid op"]]
