"""The registered queries, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import fixtures as fx
from tidemark import staging
from tidemark.functions.costs import spot_pnl, trade_costs
from tidemark.functions.numbers import half_up
from tidemark.operators import context, external, lineage, rollup, rules, trailing
from tidemark.operators import indicators as ind
from tidemark.operators import leaderboard as lb
from tidemark.operators import metrics as met
from tidemark.operators import resample as rs
from tidemark.operators.indicators import Request
from tidemark.operators.rules import Condition, Rule
from tidemark.operators.signals import add_signal, signal_chunks
from tidemark.functions.intervals import since
from tidemark.plans import barriers, features, research, rulebook, slices
from tidemark.plans.cooldown import thin
from tidemark.plans.series import index_rows
from tidemark.sources import payloads, results, store, versions
from tidemark.streaming import keyed, sinks, state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BAR = rs.BAR


def edge(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: zone-less timestamps and rounded doubles."""
    out = {}
    for f in df.schema:
        if isinstance(f.dataType, T.TimestampType):
            out[f.name] = F.col(f.name).cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DoubleType):
            out[f.name] = half_up(F.col(f.name), digits)
    return df.withColumns(out) if out else df


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: edge(fn(spark, sf_dir))
    return fn


@query
def resample_bars(spark, sf):
    return rs.resample_many(fx.bars(spark, sf), ["1h", "4h", "12h", "1d"])


def _indicators(*requests: Request, keep=("symbol", "ts")) -> Query:
    def run(spark, sf):
        return ind.add_indicators(fx.series(spark, sf), requests).select(*keep, *(r.out for r in requests))

    return run


def _register(name: str, fn: Query) -> None:
    fn.__name__ = name
    query(fn)


for _name, _requests in {
    "indicator_vwap": [Request("vwap", "vwap")],
    "indicator_shift_diff": [
        Request("shift_3", "shift", {"period": 3}),
        Request("diff_3", "diff", {"period": 3}),
        Request("pct_3", "pct_change", {"period": 3}),
    ],
    "indicator_rolling": [
        Request("sma", "sma"),
        Request("std", "std"),
        Request("hi", "max_roll", {"column": "high"}),
        Request("lo", "min_roll", {"column": "low"}),
    ],
    "indicator_obv": [Request("obi", "obi")],
    "indicator_atr": [Request("atr_14", "atr")],
    "indicator_ema": [Request("ema_9", "ema", {"period": 9}), Request("ema_50", "ema", {"period": 50})],
    "indicator_rsi": [Request("rsi_14", "rsi")],
    "indicator_macd": [Request(n, n) for n in ("macd", "macd_signal", "macd_hist")],
    "indicator_heikin_ashi": [Request(n, n) for n in ("ha_open", "ha_high", "ha_low", "ha_close")],
    "indicator_adx": [Request("adx_14", "adx")],
    "indicator_regime": [Request("regime", "regime")],
    "indicator_by_name": [
        Request("rsi", "rsi", {"period": 7}),
        Request("ema", "ema"),
        Request("atr", "atr", {"period": 10}),
        Request("price", "close"),
    ],
}.items():
    _register(_name, _indicators(*_requests))


@query
def indicators_all(spark, sf):
    return ind.add_all(fx.series(spark, sf)).drop("rn", "n")


@query
def indicator_derived(spark, sf):
    if not ind.known("ema_gap_pct"):
        ind.register(
            "ema_gap_pct", "(close - {base}) / {base} * 100", {"base": ("ema", {"period": "{period}"})}, {"period": 20}
        )
        ind.register("volume_root", "sqrt(abs(close - {v}))", {"v": ("ema", {"column": "volume", "period": 10})})
    series = fx.series(spark, sf)
    df = ind.add_indicators(series, [Request("ema_gap_pct", "ema_gap_pct"), Request("volume_root", "volume_root")])
    df = ind.whole_series(df, series, top=F.max("close"))
    return df.select("symbol", "ts", "ema_gap_pct", "volume_root", F.expr("close / top").alias("share_of_top"))


for _name, _signal in {
    "signal_rsi": "rsi_mean_reversion",
    "signal_macd": "macd_crossover",
    "signal_ema": "ema_trend",
    "signal_vwap": "vwap_bounce",
    "signal_ha_streak": "heikin_ashi_streak",
}.items():
    _register(
        _name, lambda spark, sf, s=_signal: add_signal(fx.series(spark, sf), s).select("symbol", "ts", "signal")
    )


@query
def signal_cooldown(spark, sf):
    ch = signal_chunks(fx.series(spark, sf), "vwap_bounce", after=1)
    found = barriers.candidates(ch).select("symbol", "rn")
    parts = [thin(found, ["symbol"], c).withColumn("cooldown", F.lit(c)) for c in (2, 5, 12)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def trade_costs_query(spark, sf):
    size, entry = F.col("l_quantity"), F.col("l_extendedprice")
    direction = F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL")
    leave = entry * (1 + F.col("l_tax") - F.col("l_discount"))
    costs = {k: half_up(c, 6).alias(k) for k, c in trade_costs(size, bar_volume=entry * 100).items()}
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        direction.alias("direction"), *costs.values(), half_up(spot_pnl(direction, entry, leave, size), 6).alias("gross"),
    )


QUERIES["trade_costs"] = QUERIES.pop("trade_costs_query")


def _vwap_trades(spark, sf):
    series = fx.series(spark, sf)
    return barriers.backtest(signal_chunks(series, "vwap_bounce", after=1), series, tp=2.0, sl=0.9)


@query
def backtest_trades(spark, sf):
    return _vwap_trades(spark, sf).drop("net_raw")


@query
def backtest_summary(spark, sf):
    return met.summarise(_vwap_trades(spark, sf), ["symbol"])


# rules ---------------------------------------------------------------------------------

CONDITIONS = {
    "rules_threshold": [
        Condition("rsi", "lt", 45), Condition("close", "gt", 60), Condition("volume", "lte", 300),
        Condition("adx", "gte", 20), Condition("regime", "eq", 2), Condition("regime", "ne", 2),
        Condition("nosuch", "lt", 5), Condition("nosuch", "gt", 5),
    ],
    "rules_cross": [
        Condition("close", "cross_above", 50), Condition("rsi", "cross_below", 50), Condition("macd_hist", "cross_above", 0),
    ],
    "rules_rolling": [
        Condition("close", "gt_rolling", rolling="sma", period=20), Condition("close", "lt_rolling", rolling="ema", period=20),
        Condition("volume", "gt_rolling", rolling="sma", period=10), Condition("rsi", "lt_rolling", rolling="ema", period=10),
    ],
    "rules_streak": [
        Condition("macd_hist", "streak_gte"), Condition("diff", "streak_lte", 2, period=4),
        Condition("close", "streak_gte", 6, period=5), Condition("obi", "streak_gte", 4, period=6),
    ],
}


def _conditions(conditions) -> Query:
    def run(spark, sf):
        ch, holds = rules.condition_chunks(fx.series(spark, sf), conditions)
        columns = {f"c{i}": c.cast("int") for i, c in enumerate(holds)}
        return ch.add(**columns).own().select("symbol", "ts", *columns)

    return run


for _name, _list in CONDITIONS.items():
    _register(_name, _conditions(_list))

RULE = Rule("r", (Condition("rsi", "lt", 55), Condition("close", "lt_rolling", rolling="sma", period=20)))
PLAIN_RULES = [
    Rule("h1", (Condition("close", "lt", 40),)),
    Rule("h2", (Condition("close", "gt_rolling", rolling="sma", period=20), Condition("volume", "gt", 150))),
    Rule("h3", (Condition("close", "cross_above", 50),)),
    Rule("h4", (Condition("volume", "lt", 100), Condition("close", "gte", 20)), 2.0, 0.9, 12),
]
RANDOM_RULES = rules.random_rules(24, seed=7)


@query
def rules_evaluate(spark, sf):
    return rules.evaluate(fx.series(spark, sf), RULE).select("symbol", "ts", "signal")


def _documents(spark, sf):
    return rules.parse_documents(
        fx.rule_documents(fx.table(spark, sf, "part"), "p_partkey", "p_size", "p_retailprice")
    )


@query
def rules_validate(spark, sf):
    return rules.validate(_documents(spark, sf)).select(
        "rule_key", "valid", F.concat_ws("; ", "errors").alias("errors")
    )


@query
def rules_fingerprint(spark, sf):
    return _documents(spark, sf).select("rule_key", rules.fingerprint().alias("fp"))


@query
def rules_dedup(spark, sf):
    suppliers = fx.table(spark, sf, "supplier").withColumn("s_suppkey", F.col("s_suppkey") * 9)
    old = rules.parse_documents(fx.rule_documents(suppliers, "s_suppkey", "s_nationkey", "s_acctbal"))
    fresh = _documents(spark, sf).withColumn("fp", rules.fingerprint())
    return rules.dedup(fresh, ["rule_key"], old.select(rules.fingerprint().alias("fp"))).select("rule_key", "fp")


@query
def rule_sweep(spark, sf):
    trades = research.sweep(fx.series(spark, sf), RANDOM_RULES)
    return met.summarise(trades, ["rule_id", "symbol"], with_pvalue=False)


def _stored_rules(spark, sf):
    """Documents written by one job, read by another, and deduplicated against the log of rules tried before."""
    path, log = _fresh(spark, "documents", "log")
    results.write_documents(fx.stored_documents(fx.table(spark, sf, "part"), "p_partkey", "p_size"), path)
    old = rules.parse_documents(fx.stored_documents(fx.table(spark, sf, "nation"), "n_nationkey", "n_regionkey"))
    old = rules.validate(old).filter("valid").select(rules.fingerprint().alias("fp"), F.col("rule.name").alias("name"))
    results.record_fingerprints(old, log)
    tried, _ = rulebook.load(spark, path, results.seen_fingerprints(spark, log))
    return staging.save(rulebook.rule_table(tried), "tried")


@query
def rule_store_sweep(spark, sf):
    trades = rulebook.sweep(fx.series(spark, sf), _stored_rules(spark, sf))
    return met.summarise(trades, ["rule_id", "symbol"], with_pvalue=False)


@query
def rule_store_screen(spark, sf):
    train = slices.holdout(fx.series(spark, sf)).filter("split = 'train'").drop("split")
    return rulebook.screened_sweep(train, _stored_rules(spark, sf))


@query
def rule_screen(spark, sf):
    train = slices.holdout(fx.series(spark, sf)).filter("split = 'train'").drop("split")
    return research.screened_sweep(train, PLAIN_RULES)


@query
def param_sweep(spark, sf):
    grid = research.parameter_grid("ema_trend", 2)
    scored = research.parameter_sweep(fx.series(spark, sf), "ema_trend", grid, tp=2.0, sl=0.9)
    return research.elite(scored, len(grid), ratio=0.5).select(
        "candidate", "symbol", "n_trades", "sharpe", "fitness", "rank"
    )


# evaluation and ranking ------------------------------------------------------------------


@query
def max_drawdown(spark, sf):
    return met.max_drawdown(index_rows(fx.pnl(spark, sf), ["run_id"], ["seq"], "pnl"), ["run_id"])


@query
def bootstrap_pvalue(spark, sf):
    return met.bootstrap_pvalue(index_rows(fx.pnl(spark, sf), ["run_id"], ["seq"], "pnl"), ["run_id"])


@query
def temporal_split(spark, sf):
    series = fx.series(spark, sf)
    columns = ["part", "symbol", "ts", "rn"]
    split = slices.holdout(series).withColumnRenamed("split", "part").select(columns)
    for part, rows in (("recent", slices.recent(series, 300)), ("tail", slices.last_rows(series))):
        split = split.unionByName(rows.withColumn("part", F.lit(part)).select(columns))
    return split


@query
def walk_forward_folds(spark, sf):
    return research.walk_forward(fx.series(spark, sf), "macd_crossover")


@query
def walk_forward_summary(spark, sf):
    return research.walk_forward_summary(research.walk_forward(fx.series(spark, sf), "vwap_bounce"))


@query
def holdout_overfit(spark, sf):
    return research.holdout_comparison(fx.series(spark, sf), PLAIN_RULES)


@query
def market_context(spark, sf):
    needed = [Request("regime", "regime"), Request("adx_14", "adx")]
    return context.market_context(ind.add_indicators(fx.series(spark, sf), needed), back=300)


@query
def equity_curve(spark, sf):
    return context.equity_curve(_vwap_trades(spark, sf))


@query
def leaderboard_compact(spark, sf):
    """Two generations of log lines, the older one with fewer columns, and some broken lines."""
    board = fx.board(spark, sf)
    older, newer = board.filter("generation < 12"), board.filter("generation >= 12")
    rows = lb.add_rows(older.drop("oos_sharpe", "oos_trades", "overfit"), newer)
    line = F.to_json(F.struct(*rows.columns))
    broken = F.col("run_id").cast("long") % 50 == 7
    log = staging.new_path(spark, "log")
    rows.select(F.when(broken, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(log)
    return lb.compact(spark, log).select(*board.columns).withColumn("overfit", F.col("overfit").cast("int"))


@query
def leaderboard_topk(spark, sf):
    return lb.top(fx.board(spark, sf), 25, 0.2).select("run_id", "sharpe", "n_trades", "oos_sharpe")


@query
def leaderboard_topk_per_group(spark, sf):
    return lb.top_per_group(fx.board(spark, sf), ["generation"]).select("generation", "rank", "run_id", "sharpe")


@query
def leaderboard_digest(spark, sf):
    return lb.digest(fx.board(spark, sf))


@query
def lineage_chain(spark, sf):
    return lineage.chains(fx.lineage(spark, sf), ["logged"])


# external series ---------------------------------------------------------------------------


def _landed_json(spark, sf):
    """Orders as JSON payloads of up to 100 items: times in four notations, some faulty items."""
    k, ts = F.col("o_orderkey"), F.col("o_orderdate") + F.expr("INTERVAL 7305 DAYS")
    seconds = F.unix_seconds(ts)
    when = (
        F.when(k % 31 == 0, F.lit("null"))
        .when(k % 4 == 0, (seconds * 1000).cast("string"))
        .when(k % 4 == 1, seconds.cast("string"))
        .when(k % 4 == 2, F.concat(F.lit('"'), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"')))
        .otherwise(F.concat(F.lit('"'), seconds.cast("string"), F.lit('"')))
    )
    value = F.when(k % 29 == 0, F.lit('"bad"')).otherwise(F.col("o_totalprice").cast("string"))
    block = F.floor(k / 100)
    named = F.concat(F.lit('{"timestamp":'), when, F.lit(',"value":'), value, F.lit("}"))
    item = F.when(block % 4 == 2, F.concat(F.lit("["), when, F.lit(","), value, F.lit("]"))).otherwise(named)
    return (
        fx.table(spark, sf, "orders")
        .groupBy(F.concat_ws("/", "o_orderpriority", (block % 4).cast("string")).alias("source"), block.alias("payload_id"))
        .agg(F.concat(F.lit("["), F.concat_ws(",", F.array_sort(F.collect_list(F.struct(k, item.alias("t"))))["t"]), F.lit("]")).alias("list"))
        .withColumn("under", F.when(F.col("payload_id") % 4 == 2, "prices").when(F.col("payload_id") % 4 == 0, "data"))
        .withColumn("payload", F.coalesce(F.concat(F.lit('{"'), "under", F.lit('":'), "list", F.lit("}")), "list"))
    )


@query
def external_json_parse(spark, sf):
    landed = _landed_json(spark, sf)
    nested = external.parse_json(landed.filter("under = 'data'"), "data[0].timestamp", "data[0].value")
    listed = external.parse_json(landed.filter("under = 'prices'"), "prices[0].0", "prices[0].1")
    plain = external.parse_json(landed.filter("under IS NULL"), "timestamp", "value")
    return nested.unionByName(listed).unionByName(plain)


@query
def external_csv_parse(spark, sf):
    k = F.col("o_orderkey")
    path = staging.new_path(spark, "csv")
    fx.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("source"),
        k,
        F.when(k % 23 == 0, "n/a")
        .when(k % 4 == 1, F.date_format("o_orderdate", "MM/dd/yyyy"))
        .when(k % 4 == 2, F.date_format("o_orderdate", "yyyyMMdd"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("when"),
        F.when(k % 19 == 0, "x").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
    ).write.option("header", True).csv(path)
    rows = spark.read.option("header", True).csv(path).withColumn("o_orderkey", F.col("o_orderkey").cast("long"))
    return external.parse_csv(rows, "when", "price", order=["o_orderkey"])


@query
def external_retention(spark, sf):
    k = F.col("o_orderkey")
    rows = fx.table(spark, sf, "orders").select(
        F.when(k % 10 < 7, "A").otherwise("B").alias("source"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("value"),
        k,
    )
    return external.retain(rows, "2001-08-01", 365)


@query
def external_upsert(spark, sf):
    rows = fx.table(spark, sf, "orders").select(
        F.lit("orders").alias("source"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"), "o_orderkey"
    )
    path = staging.new_path(spark, "external")
    late = (F.col("o_orderkey") % 3 == 0) & (F.col("ts") >= "1998-01-01")
    for batch in (rows.filter(~late), rows.filter(late)):
        store.upsert(batch, path, ["source", "ts"], ["source"], order=["o_orderkey"])
    return store.read(spark, path)


def _tick_observations(spark, sf):
    return fx.ticks(spark, sf).select(F.col("symbol").alias("source"), "ts", F.col("price").alias("value"))


def _order_observations(spark, sf):
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value")
    )


@query
def external_align_ffill(spark, sf):
    return external.align(_tick_observations(spark, sf), "1h", "ffill")


@query
def external_align_decay(spark, sf):
    return external.align(_tick_observations(spark, sf), "15m", "ffill", decay_periods=4)


@query
def external_align_interpolate(spark, sf):
    return external.align(_order_observations(spark, sf), "1d", "interpolate")


@query
def external_align_sum_avg(spark, sf):
    rows = _order_observations(spark, sf)
    both = [external.align(rows, "1d", m).withColumn("method", F.lit(m)) for m in ("sum", "avg")]
    return both[0].unionByName(both[1])


SYMBOLS = ["click", "error", "purchase", "signup", "view"]


def _aligned(spark, sf):
    """The aligned table of one timeframe, written and read back as its readers find it."""
    path = staging.new_path(spark, "aligned")
    external.write_aligned(external.align(_tick_observations(spark, sf), "4h", "ffill"), path, "4h")
    return spark.read.parquet(path).filter("timeframe = '4h'")


@query
def features_join_external(spark, sf):
    series = fx.series(spark, sf)
    aligned = _aligned(spark, sf)
    out = external.join_external(series, aligned, SYMBOLS)
    bound = external.bind_column(series, "view", aligned).select("symbol", "ts", F.col("view").alias("view_bound"))
    out = external.bind_column(out.join(bound, ["symbol", "ts"]), "nosuch")
    return out.select("symbol", "ts", "close", *SYMBOLS, "view_bound", "nosuch")


# tables and ingest -------------------------------------------------------------------------


@query
def klines_to_bars(spark, sf):
    one = F.array(F.unix_millis("ts").cast("string"), *(F.col(c).cast("string") for c in BAR))
    landed = (
        fx.bars(spark, sf).groupBy("symbol", F.to_date("ts").alias("day"))
        .agg(F.to_json(F.array_sort(F.collect_list(one))).alias("payload"))
    )
    return rs.resample(payloads.klines_to_bars(landed), "4h")


@query
def resample_calendar(spark, sf):
    bars = fx.bars(spark, sf)
    parts = [rs.resample_calendar(bars, i).withColumn("interval", F.lit(i)) for i in ("3d", "1w", "1M")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def rollup_5m_1h(spark, sf):
    return rs.rollups(fx.bars(spark, sf, "1m"))


def _named_bars(spark, sf):
    return store.normalise_bars(fx.bars(spark, sf).withColumn("symbol", F.upper("symbol")), "TEST")


def _raised(bars, by):
    return bars.filter(F.hour("ts") % 2 == 0).withColumn("close", F.col("close") + by)


@query
def bars_upsert(spark, sf):
    bars, path = _named_bars(spark, sf), staging.new_path(spark, "bars")
    store.upsert(bars, path)
    twice = _raised(bars, 1).withColumn("o", F.lit(1)).unionByName(_raised(bars, 2).withColumn("o", F.lit(2)))
    store.upsert(twice, path, order=["o"])
    return store.read(spark, path)


@query
def bars_range_scan(spark, sf):
    path = staging.new_path(spark, "bars")
    store.upsert(_named_bars(spark, sf), path)
    table = store.read(spark, path)
    part = store.scan(table, "2024-01-10 00:00:00", "2024-01-20 12:00:00").withColumn("part", F.lit("range"))
    late = table.filter(since(F.col("ts"), "2024-01-31", 5)).withColumn("part", F.lit("days"))
    return part.unionByName(late).select("part", "exchange", "symbol", "ts", *BAR)


@query
def bars_coverage(spark, sf):
    return store.coverage(_named_bars(spark, sf))


def _appended_bars(spark, sf):
    """All bars, then the even hours raised twice in one batch, compacted, then late bars of the last days raised again."""
    bars, path = _named_bars(spark, sf), staging.new_path(spark, "versions")
    versions.append(bars, path, batch="first")
    twice = _raised(bars, 1).withColumn("o", F.lit(1)).unionByName(_raised(bars, 2).withColumn("o", F.lit(2)))
    versions.append(twice, path, order=["o"], batch="second")
    versions.append(twice, path, order=["o"], batch="second")
    versions.compact(spark, path)
    versions.append(_raised(bars, 3).filter(F.col("ts") >= "2024-01-26"), path)
    return path


@query
def bars_append_compact(spark, sf):
    return versions.read(spark, _appended_bars(spark, sf))


@query
def bars_manifest_coverage(spark, sf):
    return versions.coverage(spark, _appended_bars(spark, sf))


@query
def bars_insert_ignore(spark, sf):
    bars, path = fx.bars(spark, sf), staging.new_path(spark, "copy")
    store.insert_ignore(bars.filter(F.hour("ts") % 2 == 0), path)
    again = bars.withColumn("close", F.col("close") + 1)
    store.insert_ignore(again.unionByName(again), path)
    return store.read(spark, path)


@query
def bar_gaps(spark, sf):
    return trailing.bar_gaps(fx.series(spark, sf), 3_600_000)


@query
def incremental_new_rows(spark, sf):
    bars = fx.bars(spark, sf)
    until = F.when(F.col("symbol") == "view", "2024-01-10").when(F.col("symbol") != "click", "2024-01-20")
    return store.new_rows(bars, bars.filter(F.col("ts") < until.cast("timestamp")))


@query
def features_build(spark, sf):
    bars, path = fx.bars(spark, sf), staging.new_path(spark, "features")
    aligned = _aligned(spark, sf)
    features.build_features(bars.filter(F.col("ts") < "2024-01-20"), path, aligned, SYMBOLS)
    features.build_features(bars, path, aligned, SYMBOLS)
    return features.load(spark, path, bars)


def _feature_rows(spark, sf):
    rows = ind.add_indicators(fx.series(spark, sf), [Request("sma_5", "sma", {"period": 5})])
    return rows.withColumns({"up": F.col("close") > F.col("open"), "count": F.col("volume").cast("int")}).drop("rn", "n")


@query
def features_upsert(spark, sf):
    rows, path = _feature_rows(spark, sf), staging.new_path(spark, "features")
    features.write_features(rows.drop("up"), path)
    features.write_features(rows.filter("hour(ts) % 2 = 0").withColumn("sma_5", F.col("sma_5") + 1), path)
    return store.read(spark, path, merge_schema=True)


@query
def features_range_scan(spark, sf):
    rows, path = _feature_rows(spark, sf), staging.new_path(spark, "features")
    features.write_features(rows, path)
    found = store.scan(store.read(spark, path), "2024-01-05", "2024-01-25 06:00:00")
    return found.join(store.coverage(found, ["symbol"]), "symbol").drop("month")


HOUR_MS = 3_600_000


@query
def trailing_return_30s(spark, sf):
    return trailing.trailing_return(fx.ticks(spark, sf), 6 * HOUR_MS)


@query
def trailing_trade_flow(spark, sf):
    return trailing.trailing_flow(fx.ticks(spark, sf), 6 * HOUR_MS, 12 * HOUR_MS)


@query
def feed_staleness(spark, sf):
    return trailing.staleness(fx.ticks(spark, sf), "2024-01-30 23:58:00", 1200)


# streaming ---------------------------------------------------------------------------------


def _event_stream(spark, sf):
    """The events table as a stream."""
    schema = fx.configure(spark).read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _landed_stream(rows: DataFrame, label: str):
    """A derived table landed as files and read back as a stream."""
    spark, path = rows.sparkSession, staging.new_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _fresh(spark, *labels):
    return [staging.new_path(spark, label) for label in labels]


def _envelopes(events):
    k, kind = F.col("event_id"), F.col("event_id") % 4
    symbol = F.concat(F.upper("event_type"), F.lit("USDT"))
    ms, text = F.unix_millis("ts"), F.col("value").cast("string")
    qty = F.get_json_object("props", "$.k")
    trade = F.to_json(F.struct(F.struct(
        F.lit("aggTrade").alias("e"), symbol.alias("s"), ms.alias("T"), text.alias("p"), qty.alias("q"), (k % 8 < 4).alias("m")).alias("data")))
    candle = F.to_json(F.struct(F.struct(F.lit("kline").alias("e"), symbol.alias("s"), F.struct(
        ms.alias("t"), text.alias("o"), text.alias("h"), text.alias("l"), text.alias("c"), qty.alias("v"), (k % 3 == 0).alias("x")).alias("k")).alias("data")))
    ticker = F.struct(symbol.alias("s"), text.alias("c"), F.when(k % 3 == 0, ms).alias("T"), (ms + 5).alias("E"))
    ticker = F.when(k % 8 < 4, F.to_json(F.struct(ticker.alias("data")))).otherwise(F.to_json(ticker))
    line = F.when(kind < 2, trade).when(kind == 2, ticker).otherwise(candle)
    return events.select(k.alias("seq"), F.when(k % 37 == 0, F.substring(line, 1, 30)).otherwise(line).alias("value"))


@query
def stream_parse_events(spark, sf):
    out, checkpoint = _fresh(spark, "events", "cp")
    sinks.drain_to_table(payloads.parse_envelopes(_envelopes(_event_stream(spark, sf))), out, checkpoint)
    flags = {c: F.col(c).cast("int") for c in ("is_buyer_maker", "is_closed")}
    return spark.read.parquet(out).withColumns(flags)


def _candles(events):
    start = F.date_trunc("hour", "ts")
    return events.select(
        F.col("event_type").alias("symbol"), F.unix_millis(start).alias("open_time_ms"), F.col("event_id").alias("seq"),
        F.col("value").alias("close"), (F.col("event_id") % 3 == 0).alias("is_closed"),
    )


@query
def stream_closed_bars(spark, sf):
    out, checkpoint = _fresh(spark, "closed", "cp")
    sinks.drain(_candles(_event_stream(spark, sf)), sinks.closed_bar_sink(out), checkpoint)
    return spark.read.parquet(out)


@query
def stream_bar_gaps(spark, sf):
    out, checkpoint = _fresh(spark, "gaps", "cp")
    sinks.drain_to_table(state.bar_gaps(_candles(_event_stream(spark, sf)), HOUR_MS), out, checkpoint)
    return spark.read.parquet(out)


@query
def stream_rollup(spark, sf):
    out, checkpoint = _fresh(spark, "rollup", "cp")
    rolled = state.rollup(fx.shape_ticks(_event_stream(spark, sf)), "1h")
    query = rolled.writeStream.outputMode("update").foreachBatch(sinks.rollup_sink(out))
    sinks._finish(query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return spark.read.parquet(out).drop("month")


def _shuffled_stream(rows: DataFrame, time: str, slices: int = 6):
    """A derived table landed as time slices of one file each, every second one before its predecessor, and an end row.

    Returns the stream (one file a micro-batch) and how late its rows may come.
    """
    spark, path = rows.sparkSession, staging.new_path(rows.sparkSession, "slices")
    rows = staging.save(rows, "landed")
    low, high = rows.agg(F.min(time), F.max(time)).first()
    width = (high - low) // slices + 1
    part = F.floor((F.col(time) - low) / width)
    for i in sorted(range(slices), key=lambda i: i ^ 1):
        rows.filter(part == i).coalesce(1).write.mode("append").parquet(path)
    end = rows.limit(1).withColumns({time: F.lit(high + 400 * 24 * HOUR_MS), "symbol": F.lit(END_OF_FEED)})
    end.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), 2 * width


END_OF_FEED = "~"


def _keyed_rows(spark, made: DataFrame) -> DataFrame:
    """The table a keyed stream leaves, without the end row's symbol."""
    out, checkpoint = _fresh(spark, "keyed", "cp")
    sinks.drain_to_table(made, out, checkpoint)
    return spark.read.parquet(out).filter(F.col("symbol") != END_OF_FEED)


@query
def stream_trailing_return(spark, sf):
    ticks, late = _shuffled_stream(fx.ticks(spark, sf).drop("ts"), "ts_ms")
    made = _keyed_rows(spark, keyed.trailing_return(ticks, 6 * HOUR_MS, late_ms=late))
    return made.filter("NOT late").drop("late")


@query
def stream_trade_flow(spark, sf):
    trades, late = _shuffled_stream(fx.ticks(spark, sf).drop("ts"), "ts_ms")
    made = _keyed_rows(spark, keyed.trailing_flow(trades, 6 * HOUR_MS, 12 * HOUR_MS, late_ms=late))
    return made.filter("NOT late").drop("late")


@query
def rollup_maintained(spark, sf):
    """Both rollups from five-minute bars that micro-batches out of order added, merged on the way and on reading."""
    ticks, _ = _shuffled_stream(fx.ticks(spark, sf).drop("ts"), "ts_ms")
    path, checkpoint = _fresh(spark, "rollup", "cp")
    timed = ticks.filter(F.col("symbol") != END_OF_FEED).withColumn("ts", F.timestamp_millis("ts_ms"))
    sinks.drain(timed, rollup.sink(path, days=12, refresh_every=3), checkpoint)
    parts = staging.save(rollup.stored(spark, path), "parts")
    both = [rollup.bars(parts, i).withColumn("interval", F.lit(i)) for i in ("5m", "1h")]
    return both[0].unionByName(both[1])


@query
def stream_candle_states(spark, sf):
    """Gaps, and the last state of each symbol, of candles that come out of order."""
    bars = fx.bars(spark, sf).select("symbol", F.unix_millis("ts").alias("open_time_ms"), F.lit(0).cast("long").alias("seq"), "volume", F.lit(True).alias("is_closed"))
    candles, late = _shuffled_stream(bars, "open_time_ms")
    rows = _keyed_rows(spark, keyed.candle_states(candles, HOUR_MS, late_ms=late)).filter("kind <> 'late'")
    gaps, states = rows.filter("kind = 'gap'"), rows.filter("kind = 'state'")
    return gaps.unionByName(store.latest(states, ["symbol"], ["at_ms"]))


@query
def stream_bar_sink(spark, sf):
    bars_path, copy_path, checkpoint = _fresh(spark, "bars", "copy", "cp")

    failed = []

    def broken(batch, batch_id):
        if not failed:
            failed.append(batch_id)
            raise ValueError("this sink fails once")

    fan = sinks.bar_sinks({"broken": broken, "bars": sinks.upsert_sink(bars_path), "copy": sinks.copy_sink(copy_path)})
    landed = _landed_stream(fx.bars(spark, sf).withColumn("exchange", F.lit("test")), "landed")
    try:
        sinks.drain(landed, fan, checkpoint)
    except StreamingQueryException:
        sinks.drain(landed, fan, checkpoint)  # the failed batch comes again, for all sinks
    columns = ["symbol", "ts", *BAR]
    bars = spark.read.parquet(bars_path).select(F.lit("bars").alias("sink"), *columns)
    return bars.unionByName(spark.read.parquet(copy_path).select(F.lit("copy").alias("sink"), *columns))


@query
def stream_features(spark, sf):
    bars_path, out, checkpoint = _fresh(spark, "bars", "features", "cp")
    sinks.drain(_landed_stream(fx.bars(spark, sf), "landed"), sinks.feature_sink(bars_path, out), checkpoint)
    return spark.read.parquet(out).drop("month")


@query
def stream_episodes(spark, sf):
    out, checkpoint = _fresh(spark, "episodes", "cp")
    signals = add_signal(fx.series(spark, sf), "vwap_bounce").drop("rn", "n")
    sinks.drain_to_table(state.episodes(_landed_stream(signals, "signals"), tp=0.5, sl=0.4), out, checkpoint)
    return state.priced(spark.read.parquet(out))


@query
def stream_snapshot(spark, sf):
    out, tail, checkpoint = _fresh(spark, "snapshot", "tail", "cp")
    sink = sinks.snapshot_sink(out, tail, fx.bars(spark, sf), 6 * HOUR_MS, 6 * HOUR_MS, 12 * HOUR_MS, HOUR_MS)
    sinks.drain(fx.shape_ticks(_event_stream(spark, sf)), sink, checkpoint)
    return sinks.latest_snapshot(spark, out)
