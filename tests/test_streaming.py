import numpy as np
import pandas as pd
import pytest
from helpers import collect, frame, make_bars
from pyspark.sql import functions as F

from tidemark import staging
from tidemark.operators import trailing
from tidemark.operators.indicators import add_all
from tidemark.operators.signals import add_signal
from tidemark.plans.series import index_rows
from tidemark.sources import store
from tidemark.streaming import sinks, state


def stream(spark, df, parts, order):
    """The rows as a stream of ``parts`` micro-batches in the given order."""
    path = staging.new_path(spark, "in")
    rows = df.toPandas().sort_values(order, ignore_index=True)
    for part in np.array_split(np.arange(len(rows)), parts):
        spark.createDataFrame(rows.iloc[part], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def paths(spark, count):
    return [staging.new_path(spark, "s") for _ in range(count)]


@pytest.fixture(scope="module")
def ticks(spark):
    rng = np.random.default_rng(1)
    rows = 240
    pdf = pd.DataFrame(
        {
            "symbol": rng.choice(["a", "b"], rows),
            "ts_ms": np.sort(rng.integers(0, 400_000, rows)),
            "seq": np.arange(rows),
            "price": rng.uniform(1, 5, rows).round(2),
            "qty": rng.integers(1, 9, rows).astype(float),
            "is_buyer_maker": rng.random(rows) < 0.5,
        }
    )
    return frame(spark, pdf).withColumn("ts", F.timestamp_millis("ts_ms"))


def test_trailing_streams_equal_the_batch_operators(spark, ticks):
    cases = [(trailing.trailing_return, {"window_ms": 30_000}, 30_000), (trailing.trailing_flow, {}, 300_000)]
    for operator, options, tail in cases:
        out, held, cp = paths(spark, 3)
        sinks.drain(stream(spark, ticks, 3, "seq"), sinks.trailing_sink(operator, out, held, tail, **options), cp)
        got = collect(spark.read.parquet(out).drop("batch_id"), "seq")
        want = collect(operator(ticks, **options), "seq")
        pd.testing.assert_frame_equal(got[want.columns], want)


def test_a_repeated_batch_replaces_itself(spark, ticks):
    out, held = paths(spark, 2)
    sink = sinks.trailing_sink(trailing.trailing_flow, out, held, 300_000)
    for batch_id in (0, 0):
        sink(ticks, batch_id)
    assert spark.read.parquet(out).count() == ticks.count()


def candles(spark, rows):
    return spark.createDataFrame(rows, "symbol string, open_time_ms long, seq long, close double, is_closed boolean")


def test_closed_candles_fire_once_with_their_first_closed_version(spark):
    t0, t1 = 1_700_000_000_000, 1_700_000_060_000
    rows = [("a", t0, 0, 1.0, False), ("a", t0, 1, 2.0, True), ("a", t0, 2, 3.0, True), ("a", t1, 3, 4.0, True), ("b", t0, 4, 5.0, False)]
    out, cp = paths(spark, 2)
    sinks.drain(stream(spark, candles(spark, rows), 3, "seq"), sinks.closed_bar_sink(out), cp)
    assert sorted((r.symbol, r.open_time_ms, r.close) for r in spark.read.parquet(out).collect()) == [("a", t0, 2.0), ("a", t1, 4.0)]
    out, cp = paths(spark, 2)
    timed = stream(spark, candles(spark, rows), 3, "seq").withColumn("ts", F.timestamp_millis("open_time_ms"))
    sinks.drain_to_table(state.once_per_bar(timed), out, cp)
    assert spark.read.parquet(out).count() == 2


def test_gap_stream_remembers_across_batches(spark):
    rows = [("a", t * 60_000, i, 1.0, True) for i, t in enumerate([0, 1, 1, 5, 6, 3, 9])]
    out, cp = paths(spark, 2)
    sinks.drain_to_table(state.bar_gaps(stream(spark, candles(spark, rows), 3, "seq")), out, cp)
    got = [(r.from_ms // 60_000, r.to_ms // 60_000, r.missing) for r in spark.read.parquet(out).orderBy("from_ms").collect()]
    assert got == [(2, 5, 3), (7, 9, 2)]


def test_rollup_merges_batches_of_one_bucket(spark, ticks):
    out, cp = paths(spark, 2)
    rolled = state.rollup(stream(spark, ticks, 3, "seq"), "5m")
    query = rolled.writeStream.outputMode("update").foreachBatch(sinks.rollup_sink(out)).option("checkpointLocation", cp)
    sinks._finish(query.trigger(availableNow=True).start(), 120)
    got = collect(spark.read.parquet(out), "symbol", "ts")
    pdf = ticks.toPandas()
    want = pdf.groupby(["symbol", pdf["ts_ms"] // 300_000])["qty"].sum()
    assert got["volume"].tolist() == want.tolist()


def test_features_of_streamed_bars(spark):
    pdf = pd.concat([make_bars(90, "a", 1), make_bars(10, "b", 2)])
    df, (bars_path, out, cp) = frame(spark, pdf), paths(spark, 3)
    fan = sinks.bar_sinks({"features": sinks.feature_sink(bars_path, out), "bars": sinks.upsert_sink(bars_path)})
    sinks.drain(stream(spark, df.withColumn("exchange", F.lit("x")), 3, "ts"), fan, cp)
    assert store.read(spark, bars_path).count() == 100
    got = collect(spark.read.parquet(out), "symbol", "ts")
    # However the bars are cut into batches, every row equals the full computation.
    want = collect(add_all(index_rows(df)), "symbol", "ts")
    assert got["symbol"].tolist() == want["symbol"].tolist()
    for c in ("rsi_14", "ema_9", "vwap", "obi", "ha_open", "atr_14"):
        np.testing.assert_allclose(got[c], want[c], rtol=1e-9, err_msg=c)


def slow_episodes(g, horizon=12, warmup=50, tp=0.005, sl=0.005):
    position, out = None, []
    for i, r in enumerate(g.itertuples(index=False)):
        if i < warmup:
            continue
        if position:
            s, e, at = position
            hit_tp = r.high >= e * (1 + tp) if s == 1 else r.low <= e * (1 - tp)
            hit_sl = r.low <= e * (1 - sl) if s == 1 else r.high >= e * (1 + sl)
            why = "tp" if hit_tp else "sl" if hit_sl else "horizon" if i - at >= horizon else None
            if why:
                out.append((s, at, i, why))
                position = None
        if position is None and r.signal:
            position = (r.signal, r.close, i)
    return out


def test_episode_stream_equals_the_bar_loop(spark):
    pdf = make_bars(260, seed=6, step=0.2)
    signals = add_signal(index_rows(frame(spark, pdf)), "ema_trend").drop("rn", "n")
    out, cp = paths(spark, 2)
    sinks.drain_to_table(state.episodes(stream(spark, signals, 4, "ts")), out, cp)
    got = collect(state.priced(spark.read.parquet(out)), "entry_ts")
    want = slow_episodes(collect(signals, "ts"))
    assert len(want) > 3
    at = {t: i for i, t in enumerate(pdf["ts"])}
    mine = [(1 if r.side == "LONG" else -1, at[r.entry_ts], at[r.exit_ts], r.exit_reason) for r in got.itertuples()]
    assert mine == want
    assert (got["bars_held"] == [b - a for _, a, b, _ in want]).all()


def test_snapshot_keeps_the_latest_row_of_every_symbol(spark, ticks):
    out, held, cp = paths(spark, 3)
    quiet = ticks.filter("symbol = 'a' OR seq < 100")
    bars = frame(spark, pd.concat([make_bars(120, "a"), make_bars(5, "b")]))
    sinks.drain(stream(spark, quiet, 3, "seq"), sinks.snapshot_sink(out, held, bars), cp)
    got = sinks.latest_snapshot(spark, out).toPandas().set_index("symbol")
    last = quiet.toPandas().groupby("symbol").last()
    assert got.loc[last.index, "price"].tolist() == last["price"].tolist()
    assert got["candles_ready"].to_dict() == {"a": 120, "b": 5}
