"""Keyed state over several micro-batches in shuffled order, with late rows; a controlled clock for silent feeds."""

import time

import numpy as np
import pandas as pd
import pytest
from helpers import collect, frame
from pyspark.sql import functions as F

from tidemark import staging
from tidemark.operators import trailing
from tidemark.streaming import keyed

START, END = 1_704_067_200_000, 4_000_000_000_000


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """State of a stream has as many stores as there are shuffle partitions, and each starts a worker per micro-batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def land(spark, parts, schema):
    """Each part one file, and so one micro-batch, in the given order."""
    path = staging.new_path(spark, "in")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream):
    spark = stream.sparkSession
    out, cp = staging.new_path(spark, "out"), staging.new_path(spark, "cp")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.read.parquet(out), query


@pytest.fixture(scope="module")
def ticks():
    rng = np.random.default_rng(1)
    rows = 600
    ts = START + np.sort(rng.integers(0, 1_200_000, rows))
    ts[100:105] = ts[100]
    return pd.DataFrame(
        {
            "symbol": rng.choice(["a", "a", "b"], rows), "ts_ms": ts, "seq": np.arange(rows), "price": rng.uniform(1, 5, rows).round(2),
            "qty": rng.integers(0, 9, rows).astype(float), "is_buyer_maker": rng.random(rows) < 0.5,
        }
    )


def last_row(ticks):
    return ticks.iloc[:1].assign(symbol="~", ts_ms=END)


@pytest.mark.parametrize("kind", ["return", "flow"])
def test_shuffled_batches_equal_the_batch_operator(spark, ticks, kind):
    schema = frame(spark, ticks).schema
    slices = [ticks.iloc[100 * i : 100 * i + 100] for i in range(6)]
    parts = [slices[i].sample(frac=1, random_state=i) for i in (1, 0, 3, 2, 5, 4)] + [last_row(ticks)]
    stream = land(spark, parts, schema)
    if kind == "return":
        made, want = keyed.trailing_return(stream, 30_000, late_ms=450_000), trailing.trailing_return(frame(spark, ticks), 30_000)
    else:
        made, want = keyed.trailing_flow(stream, late_ms=450_000), trailing.trailing_flow(frame(spark, ticks))
    got, query = run(made)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) >= 6
    assert got.filter("late").count() == 0 and keyed.dropped_rows(query) == 0
    want = collect(want, "symbol", "seq")
    pd.testing.assert_frame_equal(collect(got.drop("late"), "symbol", "seq")[want.columns], want)


def test_rows_are_emitted_as_time_passes_and_late_ones_counted(spark, ticks):
    one = ticks[ticks["symbol"] == "a"]
    early, middle, late = one[one["ts_ms"] < START + 400_000], one[one["ts_ms"].between(START + 400_000, START + 799_999)], one[one["ts_ms"] >= START + 800_000]
    held_back = early.sample(7, random_state=1)  # comes after its windows have closed
    in_time = middle.sample(5, random_state=1)  # comes late, but inside the bound
    far = one.iloc[:3].assign(ts_ms=START - 3 * keyed.DAY_MS, seq=[9001, 9002, 9003])  # beyond the grace
    parts = [early.drop(held_back.index), middle.drop(in_time.index), late.iloc[:40], pd.concat([held_back, in_time, far]), late.iloc[40:], last_row(ticks)]
    got, query = run(keyed.trailing_return(land(spark, parts, frame(spark, ticks).schema), 30_000, late_ms=460_000))
    rejected = got.filter("late").toPandas()
    assert sorted(rejected["seq"]) == sorted(held_back["seq"])
    assert keyed.dropped_rows(query) == 2 * len(far)  # each row goes to two buckets
    accepted = one.drop(held_back.index)
    want = collect(trailing.trailing_return(frame(spark, accepted), 30_000), "seq")
    pd.testing.assert_frame_equal(collect(got.filter("NOT late").drop("late"), "seq")[want.columns], want)
    sizes = [r["count"] for r in got.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 2  # not all at the end


CANDLE = "symbol string, open_time_ms long, seq long, volume double, is_closed boolean"


def test_candles_settle_in_order_with_gaps_and_late_rows(spark):
    minute = 60_000
    c = lambda at, seq, volume=1.0, closed=True, symbol="a": (symbol, START + at * minute, seq, volume, closed)
    parts = [
        [c(0, 0), c(2, 1, 5.0, False), c(1, 2)],
        [c(2, 3, 6.0), c(7, 4), c(0, 9, 1.0, True, "b")],
        [c(5, 5), c(8, 6), c(2, 7, 7.0)],  # 5 is late but in time; 2 comes again with a newer volume
        [c(40, 8, 9.0, False)],
        [c(41, 9, 4.0)],
        [c(3, 10), c(42, 11, 2.0)],  # 3 is older than what has settled
        [("~", END, 0, 0.0, False)],
    ]
    got, _ = run(keyed.candle_states(land(spark, parts, CANDLE), late_ms=10 * minute))
    rows = got.filter("symbol = 'a'").toPandas()
    gaps = rows[rows["kind"] == "gap"].sort_values("from_ms")
    assert [((int(f) - START) // minute, (int(t) - START) // minute, int(m)) for f, t, m in zip(gaps["from_ms"], gaps["to_ms"], gaps["missing"])] == [(3, 5, 2), (6, 7, 1), (9, 40, 31)]
    last = rows[rows["kind"] == "state"].sort_values("at_ms").iloc[-1]
    assert (last.volume, last.candles_ready, last.gaps) == (2.0, 8, 3)  # the one of minute 40 never closed
    assert [(int(t) - START) // minute for t in rows.loc[rows["kind"] == "late", "at_ms"]] == [3]
    assert got.filter("symbol = 'b' AND kind = 'state'").count() == 1


class Clock:
    def __init__(self):
        self.now = 0

    def getCurrentProcessingTimeInMs(self):
        return self.now


class Handle:
    """State and timers of one key in memory."""

    def __init__(self):
        self.timers, self.value = set(), None

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_a_silent_feed_shows_once_and_again_when_it_returns():
    clock, handle, feed = Clock(), Handle(), keyed._Silence(60_000)
    feed.init(handle)

    def hear(at_s):
        clock.now = at_s * 1000
        rows = pd.DataFrame({"symbol": ["a"], "ts": [pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=at_s)]})
        return [bool(x) for out in feed.handleInputRows(("a",), iter([rows]), clock) for x in out["alive"]]

    def tick(at_s):
        clock.now, seen = at_s * 1000, []
        for t in sorted(t for t in handle.timers if t <= clock.now):
            handle.timers.discard(t)
            seen += [(bool(r.alive), r.age_s) for out in feed.handleExpiredTimer(("a",), clock, None) for r in out.itertuples()]
        return seen

    assert hear(0) == [True]
    assert tick(59) == [] and hear(59) == []
    assert tick(118) == [] and tick(119) == [(False, 60.0)]
    assert tick(500) == [] and hear(600) == [True]
    assert handle.timers == {660_000}


def test_feed_changes_run_as_a_stream(spark):
    rows = [[("a", "2024-01-01"), ("b", "2024-01-01")], [("a", "2024-01-02"), ("c", "2024-01-02")]]
    stream = land(spark, rows, "symbol string, day string").select("symbol", F.to_timestamp("day").alias("ts"))
    out, cp = staging.new_path(spark, "out"), staging.new_path(spark, "cp")
    changes = keyed.feed_changes(stream, timeout_s=3600)
    # A query with timers of the clock goes on until it is stopped.
    query = changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            time.sleep(1)
            assert query.exception() is None
            if sum(p["numInputRows"] for p in query.recentProgress) >= 4:
                break
    finally:
        query.stop()
    got = spark.read.schema(keyed.FEEDS).parquet(out)
    assert sorted((r.symbol, r.alive) for r in got.collect()) == [("a", True), ("b", True), ("c", True)]
