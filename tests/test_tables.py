import json

import numpy as np
import pandas as pd
import pytest
from helpers import collect, expected_indicators, frame, make_bars
from pyspark.sql import functions as F

from tidemark import staging
from tidemark.operators import external, leaderboard, lineage, resample, trailing
from tidemark.plans import features
from tidemark.plans.series import index_rows
from tidemark.sources import payloads, results, store


def bars(spark, times, close=100.5):
    rows = [("test", "sym", t, 100.0, 101.0, 99.0, close, 1000.0) for t in times]
    return store.normalise_bars(spark.createDataFrame(rows, "exchange string, symbol string, ts string, open double, high double, low double, close double, volume double"))


# store -----------------------------------------------------------------------------------


def test_upsert_counts_rows_of_the_touched_months(spark):
    path = staging.new_path(spark, "t")
    assert store.upsert(bars(spark, ["2026-05-01 00:00:00", "2026-05-01 00:01:00"]), path) == 2
    assert store.upsert(bars(spark, ["2026-04-30 23:59:00"]), path) == 1
    assert store.upsert(bars(spark, ["2026-05-01 00:01:00"], 200.0), path) == 2
    table = store.read(spark, path)
    assert sorted(r.month for r in table.select("month").distinct().collect()) == ["2026-04", "2026-05"]
    assert table.filter("close = 200").count() == 1 and table.count() == 3
    assert store.upsert(bars(spark, []), path) == 0


def test_range_scan_and_coverage(spark):
    path = staging.new_path(spark, "t")
    assert store.read(spark, path) is None
    store.upsert(bars(spark, ["2026-05-01 00:00:00", "2026-05-01 00:01:00", "2026-05-01 00:02:00", "2026-06-02 00:00:00"]), path)
    table = store.read(spark, path)
    assert store.scan(table, "2026-05-01 00:01:00").count() == 3
    assert store.scan(table, "2026-05-01 00:01:00", "2026-05-31").count() == 2
    plan = store.scan(table, "2026-06-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "PushedFilters: [IsNotNull(ts)" in plan
    cover = store.coverage(table).first()
    assert (cover["rows"], cover.first_ts < cover.last_ts) == (4, True)
    assert store.coverage(table.limit(0)).count() == 0


def test_insert_ignore_keeps_the_first(spark):
    path = staging.new_path(spark, "t")
    store.insert_ignore(bars(spark, ["2026-05-01 00:00:00"], 1.0), path)
    twice = bars(spark, ["2026-05-01 00:00:00", "2026-05-01 00:01:00"], 2.0)
    store.insert_ignore(twice.unionByName(twice), path)
    assert sorted(r.close for r in spark.read.parquet(path).collect()) == [1.0, 2.0]


def test_new_rows_after_the_mark(spark):
    have = bars(spark, ["2026-05-01 00:00:00"])
    more = bars(spark, ["2026-05-01 00:00:00", "2026-05-01 00:00:30", "2026-05-01 00:01:00"])
    assert store.new_rows(more, have).count() == 1
    assert store.new_rows(more, have, step="INTERVAL 1 MILLISECOND").count() == 2
    assert store.new_rows(more, have.filter("false")).count() == 3


def test_incremental_features_equal_a_rebuild(spark, small_chunks):
    pdf = pd.concat([make_bars(1800, "a", 1, minutes=60), make_bars(300, "b", 2, minutes=60)])
    df, path = frame(spark, pdf), staging.new_path(spark, "f")
    cut = pd.Timestamp("2024-03-10 05:00")
    features.build_features(df.filter((F.col("ts") <= F.lit(cut)) & (F.col("symbol") == "a")), path)
    # About 560 context rows: what is older weighs less than a rounding error.
    features.build_features(df, path, context_rows=560)
    assert features.build_features(df, path, context_rows=560) == 0
    got = collect(features.load(spark, path, df), "symbol", "ts")
    assert len(got) == len(pdf)
    for symbol, g in pdf.groupby("symbol"):
        want, mine = expected_indicators(g.reset_index(drop=True)), got[got["symbol"] == symbol].reset_index(drop=True)
        for c in want:
            np.testing.assert_allclose(mine[c].astype(float), want[c].astype(float), rtol=1e-7, atol=1e-8, err_msg=f"{symbol} {c}")


# payloads --------------------------------------------------------------------------------


def test_klines(spark):
    rows = [[1714521600000, "1", "3", "0.5", "2", "10", 0], [1714521660000, "2", "x", "1", "2", "5", 0], []]
    df = spark.createDataFrame([("s", json.dumps(rows))], "symbol string, payload string")
    assert [tuple(r)[2:] for r in payloads.klines_to_bars(df).collect()] == [(1.0, 3.0, 0.5, 2.0, 10.0)]


def test_envelopes(spark):
    k = {"t": 60000, "o": "1", "h": "2", "l": "0.5", "c": "1.5", "v": "9", "x": True}
    lines = [
        json.dumps({"data": {"e": "aggTrade", "s": "BTCUSDT", "T": 5, "E": 6, "p": "100", "q": "2", "m": True}}),
        json.dumps({"data": {"e": "kline", "s": "BTCUSDT", "k": k}}),
        json.dumps({"data": {"s": "ETHUSDT", "c": "7", "T": 0, "E": 9}}),
        json.dumps({"s": "ETHUSDT", "c": "8"}),
        json.dumps({"data": {"e": "aggTrade", "s": "BTCUSDT", "T": 5, "p": "oops", "q": "2", "m": True}}),
        "{broken",
        json.dumps({"data": {"e": "other"}}),
    ]
    now = F.lit("1970-01-01 00:00:01").cast("timestamp")
    got = payloads.parse_envelopes(spark.createDataFrame([(v,) for v in lines], "value string"), now=now).collect()
    assert [(r.kind, r.asset, r.ts_ms, r.price) for r in got] == [
        ("trade", "btc", 5, 100.0), ("candle", "btc", 60000, None), ("ticker", "eth", 9, 7.0), ("ticker", "eth", 1000, 8.0)]
    assert (got[0].is_buyer_maker, got[1].close, got[1].is_closed) == (True, 1.5, True)


def test_json_observations(spark):
    nested = {"data": [
        {"timestamp": 1_700_000_000, "value": "1.5"}, {"timestamp": "1700000000000", "value": 9}, {"timestamp": "2023-11-15T00:00:00Z", "value": 2},
        {"timestamp": None, "value": 3}, {"timestamp": "soon", "value": 4}, {"timestamp": 1_700_000_100, "value": "n/a"}, {"timestamp": 9e14, "value": 1}]}
    one = {"timestamp": 1_700_000_000, "value": True}
    df = spark.createDataFrame([("many", 0, json.dumps(nested)), ("one", 0, json.dumps({"data": one}))], "source string, payload_id long, payload string")
    got = external.parse_json(df, "data[0].timestamp", "data[0].value").orderBy("source", "ts")
    got = got.select("source", F.unix_seconds("ts").alias("at"), "value").collect()
    assert [(r.source, r["at"], r.value) for r in got] == [
        ("many", 1_700_000_000, 1.5), ("many", 1_700_006_400, 2.0), ("many", 900_000_000_000, 1.0), ("one", 1_700_000_000, 1.0)]
    ints = [{"t": 1_700_000_000, "v": "7"}, {"t": 1_700_000_001, "v": "7.5"}, {"t": 1_700_000_002, "v": 7.9}]
    df = spark.createDataFrame([("s", 0, json.dumps(ints))], "source string, payload_id long, payload string")
    assert [r.value for r in external.parse_json(df, "t", "v", "int").orderBy("ts").collect()] == [7, 7]
    assert external.parse_json(df, "t", "v", "str").count() == 3


# alignment ---------------------------------------------------------------------------------


def observations(spark, seed=3, rows=60):
    rng = np.random.default_rng(seed)
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 5000, rows) * 3, unit="min")
    return pd.DataFrame({"source": "s", "ts": at, "value": rng.normal(10, 3, rows).round(2)})


def regular(pdf, freq):
    mean = pdf.groupby("ts")["value"].mean()
    return mean, pd.date_range(pdf["ts"].min().floor(freq), pdf["ts"].max().ceil(freq), freq=freq)


def test_alignment_equals_reindexing(spark, small_chunks):
    pdf = observations(spark)
    mean, idx = regular(pdf, "15min")
    df = frame(spark, pdf)
    exact = mean.reindex(idx)
    want = {
        "ffill": mean.reindex(idx, method="ffill"),
        "interpolate": exact.interpolate(method="time"),
        "sum": exact.fillna(0).rolling(2).sum(),
        "avg": exact.rolling(2).mean(),
    }
    for method, series in want.items():
        got = collect(external.align(df, "15m", method), "ts")
        assert got["ts"].tolist() == idx.tolist()
        np.testing.assert_allclose(got["value"], series, rtol=1e-9, atol=1e-9, err_msg=method)
    faded = collect(external.align(df, "15m", "ffill", decay_periods=5), "ts")["value"]
    seen = pd.Series(mean.index, index=mean.index).reindex(idx, method="ffill")
    age = ((idx - pd.DatetimeIndex(seen)) // pd.Timedelta("15min")).to_numpy()
    np.testing.assert_allclose(faded, want["ffill"] * np.clip(1 - age / 5, 0, 1), rtol=1e-9, atol=1e-9)


def test_retention(spark):
    obs = spark.createDataFrame([("big", "2020-01-01"), ("big", "2024-01-01"), ("small", "2020-01-01")], "source string, ts string")
    obs = obs.withColumn("ts", F.col("ts").cast("timestamp"))
    assert external.retain(obs, "2024-06-01").count() == 3
    assert external.retain(obs, "2024-06-01", 365).count() == 1


# trailing windows --------------------------------------------------------------------------

TICK = "symbol string, ts_ms long, seq long, price double, qty double, is_buyer_maker boolean"


def ticks(spark, *rows):
    return spark.createDataFrame([("btc", t, i, float(p), float(q), m) for i, (t, p, q, m) in enumerate(rows)], TICK)


def test_trailing_return_cases(spark):
    assert trailing.trailing_return(ticks(spark, (1000, 100, 1, False))).first().return_pct is None
    pair = trailing.trailing_return(ticks(spark, (1000, 100, 1, False), (2000, 101, 1, False)))
    assert [r.return_pct for r in pair.orderBy("ts_ms").collect()] == [None, 1.0]
    cut = trailing.trailing_return(ticks(spark, (1000, 100, 1, False), (2000, 101, 1, False), (5000, 102, 1, False)), 3000)
    last = cut.filter("ts_ms = 5000").first()
    assert (last.ticks, last.return_pct) == (2, pytest.approx(100 / 101))


def test_trailing_flow_cases(spark):
    def last(*rows, **kw):
        return trailing.trailing_flow(ticks(spark, *rows), **kw).orderBy("ts_ms").collect()[-1]

    assert last((1000, 100, 1, False), (2000, 101, 2, False)).cvd_short == 302
    assert last((1000, 100, 1, True)).cvd_short == -100
    assert last((1000, 100, 1, False), (2000, 101, 2, True)).cvd_short == -102
    assert last((1000, 100, 1, False), (2000, 200, 3, True)).vwap == 175
    evicted = last((1000, 100, 1, False), (7000, 200, 1, True), long_ms=5000)
    assert (evicted.trade_count, evicted.cvd_long) == (1, -200)
    assert last((1000, 100, 0, False)).vwap is None


def test_trailing_windows_on_a_burst(spark, small_chunks):
    rng = np.random.default_rng(4)
    spread = np.sort(np.concatenate([rng.integers(0, 4000, 500), 3_599_000 + rng.integers(0, 2000, 300)]))
    rows = [(int(t), rng.uniform(1, 9), rng.integers(1, 5), bool(rng.random() < 0.5)) for t in spread]
    df = ticks(spark, *rows)
    ret = collect(trailing.trailing_return(df, 300), "seq")
    flow = collect(trailing.trailing_flow(df, 100, 300), "seq")
    for i, (t, p, _, _) in enumerate(rows):
        inside = [r for r in rows[: i + 1] if r[0] >= t - 300]
        brief = [r for r in inside if r[0] >= t - 100]
        assert ret["ticks"][i] == flow["trade_count"][i] == len(inside)
        if len(inside) > 1:
            assert ret["return_pct"][i] == pytest.approx((p - inside[0][1]) / inside[0][1] * 100)
        assert flow["cvd_short"][i] == pytest.approx(sum((-1 if m else 1) * a * q for _, a, q, m in brief))
        assert flow["vwap"][i] == pytest.approx(sum(a * q for _, a, q, _ in inside) / sum(q for _, _, q, _ in inside))


def test_gaps_and_staleness(spark):
    pdf = make_bars(2)
    pdf["ts"] = pd.to_datetime([0, 300_000], unit="ms")
    gaps = trailing.bar_gaps(index_rows(frame(spark, pdf))).collect()
    assert [(r.from_ms, r.to_ms, r.missing) for r in gaps] == [(60_000, 300_000, 4)]
    assert trailing.bar_gaps(index_rows(frame(spark, make_bars(3)))).count() == 0
    alive = [trailing.staleness(frame(spark, pdf), t).first().alive for t in ("1970-01-01 00:05:59", "1970-01-01 00:06:00")]
    assert alive == [True, False]


# resampling, ranking, lineage ----------------------------------------------------------------


def test_resampling_equals_pandas(spark):
    pdf = make_bars(5000, minutes=30)
    agg = {"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"}
    df = frame(spark, pdf)
    for ours, theirs in {"4h": "4h", "1d": "1D"}.items():
        want = pdf.set_index("ts").resample(theirs).agg(agg).reset_index()
        pd.testing.assert_frame_equal(collect(resample.resample(df, ours), "ts").drop(columns="symbol"), want, check_dtype=False)
    for ours, theirs in {"3d": "3D", "1w": "1W", "1M": "1ME"}.items():
        want = pdf.set_index("ts").resample(theirs).agg(agg).dropna().reset_index()
        pd.testing.assert_frame_equal(collect(resample.resample_calendar(df, ours), "ts").drop(columns="symbol"), want, check_dtype=False)


def test_log_skips_broken_lines_and_fills_missing_columns(spark):
    path = staging.new_path(spark, "log")
    lines = ['{"run_id": "a", "sharpe": 1.5, "n_trades": 40}', '{"run_id": "b", "sha', '{"run_id": "c", "overfit": true}', ""]
    spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.text(path)
    got = leaderboard.compact(spark, path).orderBy("run_id").collect()
    assert [(r.run_id, r.sharpe, r.overfit) for r in got] == [("a", 1.5, None), ("c", None, True)]
    leaderboard.append_results(spark.createDataFrame([("d", 2.0, 3)], "run_id string, sharpe double, n_trades long"), path)
    board = leaderboard.compact(spark, path)
    assert [r.run_id for r in leaderboard.top(board, 1).collect()] == ["d"]
    assert [r.run_id for r in leaderboard.promising(board).collect()] == ["a"]


def test_lineage_stops_at_unknown_parents_and_in_cycles(spark):
    rows = [("a", "", 1), ("b", "a,x", 2), ("c", "b", 3), ("lost", "ghost", 1), ("p", "q", 1), ("q", "p", 1)]
    nodes = lineage.first_parents(spark.createDataFrame(rows, "strategy_id string, parent_ids string, generation int"))
    got = lineage.chains(nodes).toPandas().sort_values("hop").groupby("strategy_id")["node"].agg(list)
    assert got["c"] == ["c", "b", "a"] and got["lost"] == ["lost"]
    assert got["p"] == ["p", "q"] and got["q"] == ["q", "p"]
    assert [r.node for r in lineage.chain_of(nodes, "c").orderBy("hop").collect()] == ["c", "b", "a"]
    assert lineage.edges(nodes).filter("strategy_id = 'b'").count() == 2


def test_lineage_takes_the_first_row_and_long_chains(spark):
    rows = [("c", "b", 0), ("c", "z", 1), ("b", "a", 0), ("b", "z", 1), ("a", None, 0), ("z", None, 0)]
    rows += [(f"n{i:03}", f"n{i - 1:03}" if i else None, 0) for i in range(150)]
    nodes = spark.createDataFrame(rows, "strategy_id string, parent_id string, logged int")
    assert [r.node for r in lineage.chain_of(nodes, "c", ["logged"]).orderBy("hop").collect()] == ["c", "b", "a"]
    assert lineage.chain_of(nodes, "n149", ["logged"]).count() == 150


def test_lineage_writes_a_row_per_strategy_and_step_not_per_node(spark, monkeypatch):
    n, written, save = 1000, [], staging.save
    monkeypatch.setattr(staging, "save", lambda df, label: [made := save(df, label), written.append(made.count())][0])
    got = lineage.chains(spark.createDataFrame([(i, i // 2 or None) for i in range(1, n + 1)], "strategy_id long, parent_id long"))
    assert {r.strategy_id: r["count"] for r in got.groupBy("strategy_id").count().collect()} == {i: i.bit_length() for i in range(1, n + 1)}
    assert sum(written) < 8 * n


def test_lineage_of_circles_with_tails_and_odd_ids(spark):
    parent = {i: int(p) for i, p in enumerate(np.random.default_rng(5).integers(0, 330, 300))} | {7: 7, 8: 9, 9: 8, **{i: i + 1 for i in range(200, 237)}, 237: 200}
    rows = [*parent.items(), (None, 3), (None, None)]
    got: dict = {}
    for r in lineage.chains(spark.createDataFrame(rows, "strategy_id long, parent_id long")).collect():
        got.setdefault(r.strategy_id, {})[r.hop] = r.node
    want = {None: [None]}
    for i in parent:
        chain, at = [], i
        while at in parent and at not in chain:
            chain.append(at)
            at = parent[at]
        want[i] = chain
    assert {k: [v[h] for h in range(len(v))] for k, v in got.items()} == want


def test_numeric_looking_partition_names_keep_their_rows(spark):
    path = staging.new_path(spark, "exchange")
    for i, ts in enumerate(("2026-05-01 00:00:00", "2026-05-01 00:01:00", "2026-05-01 00:02:00")):
        assert store.upsert(bars(spark, [ts], float(i)).withColumn("exchange", F.lit("007")), path) == i + 1
    twice = bars(spark, ["2026-05-01 00:00:00"], 8.0).unionByName(bars(spark, ["2026-05-01 00:00:00"], 9.0)).withColumn("exchange", F.lit("007"))
    assert store.upsert(twice, path) == 3
    got = store.read(spark, path).orderBy("ts").collect()
    assert [(r.exchange, r.close) for r in got] == [("007", 9.0), ("007", 1.0), ("007", 2.0)]


def test_nanosecond_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    at = pa.array([1_700_000_000_123_456_789, None], pa.timestamp("ns", tz="UTC"))
    pq.write_table(pa.table({"ts": at, "close": [1.0, 2.0]}), tmp_path / "a.parquet", version="2.6")
    got = store.read_nanos(spark, f"file://{tmp_path}").orderBy("close").select(F.unix_micros("ts").alias("us"), "close").collect()
    assert [(r.us, r.close) for r in got] == [(1_700_000_000_123_456, 1.0), (None, 2.0)]


def test_log_keeps_rows_with_odd_values(spark):
    path = staging.new_path(spark, "log")
    lines = ['{"run_id": "a", "n_trades": 40.0, "llm_confidence": "high", "new": 7}', "{broken", "[1]", " "]
    spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.text(path)
    (row,) = leaderboard.read_log(spark, path).collect()
    assert (row.run_id, row.n_trades, row.llm_confidence) == ("a", 40, None) and json.loads(row.line)["new"] == 7
    assert sorted(r.value for r in leaderboard.broken_lines(spark, path).collect()) == ["[1]", "{broken"]


def test_digest_with_text_ids(spark):
    board = spark.createDataFrame([("b1", 2.0, 20), ("a2", 2.0, 20), ("c", 1.0, 20)], "run_id string, sharpe double, n_trades long")
    board = board.withColumns({"oos_trades": F.lit(0).cast("long"), "overfit": F.lit(False)})
    assert leaderboard.digest(board).first().best_run == "a2"


def test_external_forms(spark):
    body = '{"prices": [[1704067200000, 5.5], [1704067260000, "6"], ["x", 1]]}'
    rows = spark.createDataFrame([("s", body, 1)], "source string, payload string, payload_id int")
    got = external.parse_json(rows, "prices[0].0", "prices[0].1").orderBy("ts").collect()
    assert [r.value for r in got] == [5.5, 6.0]
    times = ["01/02/2024", "20240102", "2024-01-02T00:00:00Z", "02-Jan-2024", "no"]
    csv = spark.createDataFrame([("s", t, str(9 - i), i) for i, t in enumerate(times)], "source string, when string, price string, at int")
    (row,) = external.parse_csv(csv, "when", "price", order=["at"]).collect()
    assert (str(row.ts), row.value) == ("2024-01-02 00:00:00", 9.0)


def test_runs_and_logs(spark):
    path = staging.new_path(spark, "runs")
    trades = spark.createDataFrame([(1, 2.0)], "rn long, net_pnl double")
    summary = spark.createDataFrame([("a", 1)], "symbol string, n_trades long")
    for run in ("000000000123", "r2", "000000000123"):
        results.save_run(trades, summary, path, run, "vwap_bounce", {"horizon": 12, "nest": {"a": 1}}, "2024-01-01")
    got = results.read_run(spark, path).orderBy("run_id").collect()
    assert [(r.run_id, json.loads(r.config)) for r in got] == [("000000000123", {"horizon": 12, "nest": {"a": 1}}), ("r2", {"horizon": 12, "nest": {"a": 1}})]
    assert results.read_run(spark, path, "trades").count() == 2

    log = staging.new_path(spark, "fp")
    assert results.seen_fingerprints(spark, log).count() == 0
    for _ in range(2):
        results.record_fingerprints(spark.createDataFrame([("x", "n")], "fp string, name string"), log)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(log)
    assert [r.fp for r in results.seen_fingerprints(spark, log).collect()] == ["x"]

    out = staging.new_path(spark, "bars")
    df = frame(spark, make_bars(100))
    for interval in ("1h", "4h", "1h"):
        results.write_resampled(resample.resample(df, interval), out, interval)
    assert spark.read.parquet(out).groupBy("interval").count().count() == 2


def test_scope_drops_what_was_staged_inside(spark):
    with staging.scope(spark):
        inside = staging.save(spark.range(3), "gone")
        path = inside.inputFiles()[0].rsplit("/", 1)[0]
        assert store.exists(spark, path)
    assert not store.exists(spark, path)
