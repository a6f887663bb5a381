"""Views over the shared test tables that have the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.resample import ticks_to_bars
from tidemark.plans.series import index_rows
from tidemark.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, zone-less timestamps taken as UTC."""
    df = configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns(
        {f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)}
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_ticks(table(spark, sf_dir, "events"))


def shape_ticks(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("qty"),
        (F.col("event_id") % 2 == 1).alias("is_buyer_maker"),
    )


def bars(spark: SparkSession, sf_dir: str, interval: str = "1h") -> DataFrame:
    return ticks_to_bars(ticks(spark, sf_dir), interval)


def series(spark: SparkSession, sf_dir: str, interval: str = "1h") -> DataFrame:
    return index_rows(bars(spark, sf_dir, interval))


def pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed results per run, in a total order."""
    order = ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    net = F.round(F.col("l_extendedprice") * (F.col("l_discount") - 0.05) / 100, 2)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("run_id"), F.struct(*order).alias("seq"), net.alias("net_pnl")
    )


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    first = table(spark, sf_dir, "orders").select(
        key.alias("strategy_id"),
        F.when(key > 0, F.floor(key / 2)).alias("parent_id"),
        F.col("o_totalprice").alias("fitness"),
        F.lit(0).alias("logged"),
    )
    # Some strategies are logged again later, with another parent.
    again = first.filter("strategy_id % 7 = 3").withColumns({"parent_id": F.floor(F.col("strategy_id") / 3), "logged": F.lit(1)})
    return first.unionByName(again)


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    return (
        table(spark, sf_dir, "customer")
        .join(trades, "c_custkey", "left")
        .select(
            F.col("c_custkey").cast("string").alias("run_id"),
            F.col("c_nationkey").alias("generation"),
            (F.col("c_acctbal") / 10000).alias("sharpe"),
            F.coalesce("k", F.lit(0)).alias("n_trades"),
        )
        .withColumn("oos_sharpe", F.col("sharpe") - (F.col("run_id").cast("long") % 7) / 10)
        .withColumn("oos_trades", F.floor(F.col("n_trades") / 2))
        .withColumn("overfit", (F.col("oos_sharpe") < F.col("sharpe") - 0.3) & (F.col("oos_trades") >= 10))
    )


# What the rule documents below draw from; the last entries are deliberate faults.
DOC_INDICATORS = ["rsi", "adx", "close", "volume", "macd", "ema", "vwap", None]
DOC_OPS = [
    "lt", "gt", "lte", "gte", "eq", "ne", "cross_above", "cross_below",
    "gt_rolling", "lt_rolling", "streak_gte", "streak_lte", "between", None,
]
DOC_ROLLING = ["sma", "ema", "wma", None]


def _choice(values: list, index: str) -> str:
    items = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"element_at(array({items}), cast(({index}) % {len(values)} as int) + 1)"


def rule_documents(rows: DataFrame, key: str, size: str, number: str) -> DataFrame:
    """One JSON rule document per row of a table, some of them faulty in various ways."""
    value = f"CASE WHEN {key} % 11 = 0 THEN '\"high\"' WHEN {key} % 7 = 0 THEN 'null' ELSE cast({number} as string) END"
    condition = f"""named_struct(
        'indicator', {_choice(DOC_INDICATORS, f'{key} + 3 * j')}, 'op', {_choice(DOC_OPS, f'{size} + 5 * j')},
        'value', parse_json({value}), 'rolling', {_choice(DOC_ROLLING, f'{key} + j')},
        'period', if(({key} + j) % 5 = 0, NULL, 10 + {size}))"""
    return rows.selectExpr(
        f"{key} AS rule_key",
        f"""to_json(named_struct(
            'name', if({key} % 13 = 0, NULL, concat('rule_', {key})),
            'entry_conditions', if({key} % 17 = 0, NULL, transform(sequence(0L, {key} % 3), j -> {condition})),
            'exit', named_struct('tp_pct', 0.04D, 'sl_pct', 0.015D, 'horizon_bars', 48))) AS document""",
    )


# What the stored rule documents draw from, with the level of each indicator as a function of ``s``.
STORED_LEVELS = {"rsi": "30 + s * 0.8D", "close": "25 + s * 1D", "volume": "s * 10D", "macd": "(s - 25) / 10D", "ema": "25 + s * 1D"}
STORED_OPS = ["lt", "gt", "lte", "gte", "cross_above", "cross_below", "gt_rolling", "lt_rolling", "streak_gte"]


def stored_documents(rows: DataFrame, key: str, size: str) -> DataFrame:
    """One rule document per row of a table, all but every thirteenth valid; levels fit the bars of these tables."""
    i, o = f"cast(({key} * 7 + s * 3 + j * (1 + s % 4)) % 5 as int)", f"cast(({key} + s * 5 + j * (4 + {key} % 7)) % 9 as int)"
    level = " ".join(f"WHEN {n} THEN {v}" for n, v in enumerate(STORED_LEVELS.values()))
    condition = f"""named_struct(
        'indicator', element_at(array({', '.join(repr(x) for x in STORED_LEVELS)}), {i} + 1),
        'op', if({key} % 13 = 0, 'between', element_at(array({', '.join(map(repr, STORED_OPS))}), {o} + 1)),
        'value', if({o} = 8, 3D, CASE {i} {level} END), 'rolling', 'sma', 'period', 20)"""
    return rows.withColumn("s", F.expr(f"cast({size} as long)")).selectExpr(
        f"""to_json(named_struct(
            'name', concat('rule_', {key}),
            'entry_conditions', transform(sequence(0L, {key} % 3), j -> {condition}),
            'exit', named_struct('tp_pct', 0.01D + ({key} % 4) / 100D, 'sl_pct', 0.01D + ({key} % 3) / 100D,
                                 'horizon_bars', element_at(array(12, 24, 48), cast({key} % 3 as int) + 1)))) AS document""",
    )
