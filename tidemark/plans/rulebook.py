"""Rules as a table: from stored documents to trades without a list of rules on the driver.

A *condition index* stands between bars and rules.  Rules name conditions, and conditions name operands: an indicator
and what it is compared with (a level, its own previous value, a rolling mean, a run of signs).  Distinct operands are
few, so they are columns, computed in passes of at most ``OPERANDS``; distinct conditions are rows, at most
``CONDITIONS`` of them per pass, and each leaves one bitmap per chunk of ``SPAN`` bars.  Rules then meet the bitmaps of
their conditions in a join and AND them.  Plans and what the driver holds are bounded by a pass, not by the rules.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import staging
from tidemark.operators import rules as R
from tidemark.operators.indicators import REGISTRY
from tidemark.operators.metrics import summarise
from tidemark.operators.rules import Condition
from tidemark.plans import slices
from tidemark.plans.barriers import first_touch, price
from tidemark.plans.cooldown import thin
from tidemark.plans.series import index_rows

OPERANDS = 24
CONDITIONS = 2048
SPAN = 4096  # bars of a bitmap
PARTS = 16  # a condition that many rules share meets their rows in so many parts

# What an exit leaves out, as in ``rules.Rule``.
TP, SL, HORIZON = 0.05, 0.02, 48


# rules and conditions as rows ------------------------------------------------------------------


def load(spark: SparkSession, path: str, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Stored documents as rules to be tried, and the documents that are not valid (with their ``errors``).

    Of rules with equal fingerprints the one whose name (then text) comes first is tried; none is that ``seen`` holds.
    """
    documents = R.validate(R.parse_documents(spark.read.text(path).withColumnRenamed("value", "document")))
    documents = documents.withColumns({"name": F.col("rule.name"), "fp": R.fingerprint()})
    fresh = R.dedup(documents.filter("valid"), ["name", "document"], seen)
    return fresh.select("fp", "name", "rule"), documents.filter("NOT valid").select("document", "errors")


def rule_table(rules: DataFrame, rule_id: str = "name") -> DataFrame:
    """``rule_id, tp, sl, horizon, conditions`` of parsed rules, one row per rule."""
    end = F.col("rule.exit")
    return rules.select(
        F.col(rule_id).alias("rule_id"),
        F.coalesce(end["tp_pct"], F.lit(TP)).alias("tp"),
        F.coalesce(end["sl_pct"], F.lit(SL)).alias("sl"),
        F.coalesce(end["horizon_bars"], F.lit(HORIZON)).cast("int").alias("horizon"),
        F.col("rule.entry_conditions").alias("conditions"),
    )


def _known_params() -> Column:
    """The names of the parameters each indicator takes, as a map column."""
    entries = [F.lit(x) for name, (defaults, _) in REGISTRY.items() for x in (name, ",".join(defaults))]
    return F.create_map(*entries)


def conditions_of(rules: DataFrame) -> DataFrame:
    """Each rule's distinct conditions with ``condition_id`` and ``operand`` (texts that say all they depend on)."""
    c = F.col("c")
    whole = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    names = F.split(_known_params()[c["indicator"]], ",")
    params = F.array_sort(F.coalesce(F.map_entries(c["params"]), F.array().cast("array<struct<key:string,value:double>>")))
    params = F.filter(params, lambda p: F.coalesce(F.array_contains(names, p["key"]), F.lit(False)))
    source = F.concat_ws("|", c["indicator"], F.concat_ws(",", F.transform(params, lambda p: F.concat_ws("=", p["key"], p["value"].cast("string")))))
    level = F.coalesce(F.try_variant_get(c["value"], "$", "double"), F.try_variant_get(c["value"], "$", "boolean").cast("double"))
    need = F.greatest(F.ceil(F.when(F.coalesce(level, F.lit(0.0)) == 0, 3.0).otherwise(level)), F.lit(0))
    kind = (
        F.when(c["op"].isin(*R.THRESHOLD_OPS), F.lit("level"))
        .when(c["op"].isin(*R.CROSS_OPS), F.lit("cross"))
        .when(c["op"].isin(*R.ROLLING_OPS), F.concat_ws(":", F.lit("mean"), whole(c["rolling"]), whole(c["period"])))
        .otherwise(F.concat_ws(":", c["op"], whole(need)))
    )
    reach = F.coalesce(F.when(c["period"] != 0, c["period"]), F.lit(5))
    rows = rules.select("rule_id", F.explode("conditions").alias("c")).select(
        "rule_id",
        F.concat_ws("|", source, kind).alias("operand"),
        F.when(c["op"].isin(*R.ROLLING_OPS), None).otherwise(level).alias("value"),
        c["op"].alias("op"), c["indicator"].alias("indicator"), params.alias("params"), c["rolling"].alias("rolling"),
        F.when(c["op"].isin(*R.STREAK_OPS), reach).otherwise(c["period"]).alias("period"),
    )
    return rows.withColumn("condition_id", F.md5(F.concat_ws("|", "operand", "op", whole(F.col("value")), whole(F.col("period"))))).distinct()


# the index ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Pass:
    """The conditions of one pass over the bars: bounded in operands and in conditions."""

    conditions: list[Row]

    def of(self, row: Row) -> Condition:
        defaults = REGISTRY[row["indicator"]][0] if row["indicator"] in REGISTRY else {}
        params = {p["key"]: int(p["value"]) if isinstance(defaults.get(p["key"]), int) else p["value"] for p in row["params"]}
        return Condition(row["indicator"], row["op"], row["value"], params, row["rolling"], row["period"])


def passes(conditions: DataFrame) -> Iterator[Pass]:
    """Distinct conditions in bounded passes, those of an operand together as far as they fit."""
    once = staging.save(conditions.drop("rule_id").dropDuplicates(["condition_id"]), "conditions")
    all_ = F.lit(0).alias("all")
    operands = index_rows(once.select("operand", all_).distinct(), ["all"], ["operand"], "operands")
    placed = once.join(operands.select("operand", F.expr(f"rn div {OPERANDS}").alias("group")), "operand")
    placed = index_rows(placed, ["group"], ["operand", "condition_id"], "conditions").withColumn("part", F.expr(f"rn div {CONDITIONS}"))
    placed = staging.save(placed.drop("rn", "n"), "passes")
    for group, part in sorted(map(tuple, placed.select("group", "part").distinct().collect())):
        yield Pass(placed.filter((F.col("group") == group) & (F.col("part") == part)).collect())


def _operand(c: Condition) -> tuple[str, str | None]:
    """Names of the columns a condition compares, as ``rules.condition_chunks`` makes them."""
    name = R._request(c).out if R.known(c.indicator) else "_zero"
    if c.op in R.CROSS_OPS:
        return name, f"{name}_prev"
    if c.op in R.ROLLING_OPS:
        return name, f"{name}_{c.rolling}{c.period}"
    if c.op in R.STREAK_OPS and R._streak(c)[0] > 0:
        return name, f"{name}_{c.op}{R._streak(c)[0]}"
    return name, None


def _holds(c: Condition, x: np.ndarray, other: np.ndarray | None) -> np.ndarray:
    """Where a condition holds; missing values hold nothing."""
    v = np.nan if c.value is None else float(c.value)
    tests = {"lt": np.less, "gt": np.greater, "lte": np.less_equal, "gte": np.greater_equal, "eq": np.equal}
    if c.op in tests:
        return tests[c.op](x, v)
    if c.op == "ne":
        return (x != v) & ~np.isnan(x) & ~np.isnan(v)
    if c.op in R.CROSS_OPS:
        return (other <= v) & (x > v) if c.op == "cross_above" else (other >= v) & (x < v)
    if c.op in R.ROLLING_OPS:
        return x > other if c.op == "gt_rolling" else x < other
    need, reach = R._streak(c)
    if need == 0:
        return ~np.isnan(x)
    return other == need if need <= reach else np.zeros(len(x), bool)


def bitmaps(series: DataFrame, one: Pass, keys: Sequence[str]) -> DataFrame:
    """``keys, span, condition_id, bits``: the rows of each span of bars on which a condition holds, if any.

    Bit ``i`` of word ``j`` stands for row ``span * SPAN + 64 * j + i``; rows before ``FIRST_ROW`` hold nothing.
    """
    listed = [(r["condition_id"], one.of(r)) for r in one.conditions]
    # One condition of each operand stands for all of them; levels are no part of an operand.
    stand_in = {_operand(c): replace(c, value=0.0) if c.op in R.THRESHOLD_OPS + R.CROSS_OPS else c for _, c in listed}
    ch, _ = R.condition_chunks(series, list(stand_in.values()), keys)
    named = sorted({n for _, c in listed for n in _operand(c) if n})
    if "_zero" in named and "_zero" not in ch.df.columns:
        ch = ch.add(_zero=F.lit(0.0))
    rows = ch.own().select(*keys, "rn", *(F.col(n).cast("double").alias(n) for n in named), F.expr(f"rn div {SPAN}").alias("span"))
    schema = T.StructType(
        [*(series.schema[k] for k in keys), T.StructField("span", T.LongType()), T.StructField("condition_id", T.StringType()), T.StructField("bits", T.ArrayType(T.LongType()))]
    )

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        at = (pdf["rn"].to_numpy() % SPAN).astype(np.int64)
        warm = pdf["rn"].to_numpy() >= R.FIRST_ROW
        columns = {n: pdf[n].to_numpy(dtype=float) for n in named}
        ids, words = [], []
        with np.errstate(invalid="ignore"):
            for id_, c in listed:
                name, other = _operand(c)
                hit = _holds(c, columns[name], columns[other] if other else None) & warm
                if hit.any():
                    full = np.zeros(SPAN, np.uint8)
                    full[at[hit]] = 1
                    ids.append(id_)
                    words.append(np.packbits(full, bitorder="little").view("<i8").tolist())
        head = {k: pdf[k].iloc[0] for k in [*keys, "span"]}
        if not ids:
            return pd.DataFrame(columns=schema.names)
        return pd.DataFrame({**{k: [v] * len(ids) for k, v in head.items()}, "condition_id": ids, "bits": words})[schema.names]

    return rows.groupBy(*keys, "span").applyInPandas(index, schema)


def condition_index(series: DataFrame, conditions: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame | None:
    """The bitmaps of all distinct conditions, one pass over the bars after another (None without conditions)."""
    spark, path, empty = series.sparkSession, staging.new_path(series.sparkSession, "condition-index"), True
    for one in passes(conditions):
        made = bitmaps(series, one, keys)
        made.write.mode("append").parquet(path)
        empty, schema = False, made.schema
    return None if empty else spark.read.schema(schema).parquet(path)


# rules over the index ------------------------------------------------------------------------------


def fired(series: DataFrame, rules: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One row per rule and bar on which all conditions of the rule hold: ``rule_id, tp, sl, horizon``, keys and ``rn``."""
    conditions = staging.save(conditions_of(rules), "rule-conditions")
    index = condition_index(series, conditions, keys)
    head = staging.save(rules.select("rule_id", "tp", "sl", "horizon"), "rules")
    if index is None:
        bars = series.filter(F.col("rn") >= R.FIRST_ROW).limit(0).select(*keys, "rn")
        return head.limit(0).crossJoin(bars)
    wanted = conditions.groupBy("rule_id").agg(F.count(F.lit(1)).alias("_need"))
    # A condition that most rules share is one key on both sides: its bitmaps are told apart by their place.
    place = F.pmod(F.xxhash64(*keys, "span"), F.lit(PARTS)).alias("_part")
    spread = conditions.select("rule_id", "condition_id").join(wanted, "rule_id")
    spread = spread.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    met = spread.join(index.withColumn("_part", place), ["condition_id", "_part"]).groupBy("rule_id", *keys, "span")
    both = met.agg(F.first("_need").alias("_need"), F.collect_list("bits").alias("_sets"))
    all_of = F.reduce(F.slice("_sets", 2, F.size("_sets")), F.get("_sets", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    words = both.filter("size(_sets) = _need").select("rule_id", *keys, "span", F.posexplode(all_of).alias("_word", "_bits"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("_bits", i) == 1)
    rows = words.filter("_bits <> 0").select("rule_id", *keys, "span", "_word", F.explode(bits).alias("_bit"))
    rows = rows.select("rule_id", *keys, (F.col("span") * SPAN + F.col("_word") * 64 + F.col("_bit")).alias("rn"))
    return head.join(rows, "rule_id")


def sweep(
    series: DataFrame, rules: DataFrame, keys: Sequence[str] = ("symbol",), warmup: int = 50, cooldown: int = 2, size: float = 50.0,
    runs: DataFrame | None = None,
) -> DataFrame:
    """Trades of a table of rules on every series; ``runs`` (``rule_id`` and keys) keeps only the pairs it names.

    Pairs that are not wanted leave before their bars are thinned and labelled.
    """
    run = ["rule_id", *keys]
    lengths = series.groupBy(*keys).agg(F.max("n").alias("n"))
    found = fired(series, rules, keys).join(lengths, list(keys))
    found = found.filter((F.col("rn") >= warmup) & (F.col("rn") + 1 + F.col("horizon") < F.col("n")))
    if runs is not None:
        found = found.join(runs.select(*run), run, "left_semi")
    kept = thin(found, run, cooldown)
    following = series.select(*keys, (F.col("rn") - 1).alias("rn"), F.col("open").alias("entry_price"), F.col("ts").alias("entry_ts"))
    entries = kept.join(following, [*keys, "rn"]).withColumn("signal", F.lit(1))
    longest = rules.agg(F.max("horizon")).first()[0] or HORIZON
    return price(first_touch(entries, series, run, keys, longest), run, size)


def screen(series: DataFrame, rules: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Metrics of the (rule, series) pairs that do well enough on the recent rows."""
    metrics = summarise(sweep(slices.recent(series), rules, keys), ["rule_id", *keys], with_pvalue=False)
    return metrics.filter((F.col("sharpe") > -0.05) & (F.col("n_trades") >= 3))


def screened_sweep(series: DataFrame, rules: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Full evaluation of the pairs that pass the screen; the others are not labelled again, their rules not indexed."""
    run = ["rule_id", *keys]
    passed = staging.save(screen(series, rules, keys).select(*run), "screened")
    left = rules.join(passed.select("rule_id").distinct(), "rule_id", "left_semi")
    return summarise(sweep(series, left, keys, runs=passed), run, with_pvalue=False)
