"""Rollups kept from mergeable bars: order, repeated batches, late ticks, refreshes over a bounded span."""

import numpy as np
import pandas as pd
import pytest
from helpers import collect, frame
from pyspark.sql import functions as F

from tidemark import staging
from tidemark.operators import rollup
from tidemark.operators.resample import ticks_to_bars


@pytest.fixture(scope="module")
def ticks():
    rng = np.random.default_rng(8)
    rows = 900
    start = pd.Timestamp("2024-03-01").value // 1000
    us = np.sort(rng.integers(0, 4 * 86_400, rows)) * 1_000_000 + start
    us[10:14] = us[10]  # equal times, settled by seq
    ts = pd.to_datetime(us, unit="us").astype("datetime64[us]")
    return pd.DataFrame({"symbol": rng.choice(["a", "b"], rows), "ts": ts, "seq": np.arange(rows), "price": rng.uniform(1, 9, rows).round(2), "qty": rng.integers(1, 5, rows).astype(float)})


def files(path):
    """Names and times of change of all data files below a folder."""
    from pathlib import Path

    return {str(p): p.stat().st_mtime_ns for p in Path(path.removeprefix("file:")).rglob("*.parquet")}


def test_batches_in_any_order_equal_the_whole(spark, ticks):
    path = staging.new_path(spark, "rollup")
    sink = rollup.sink(path, days=10, refresh_every=2)
    order = np.random.default_rng(1).permutation(len(ticks))
    for i, part in enumerate(np.array_split(order, 6)):
        batch = frame(spark, ticks.iloc[part])
        sink(batch, i)
        sink(batch, i)  # a repeated batch replaces itself
    assert rollup.late_ticks(spark, path).count() == 0
    for interval in ("5m", "1h"):
        got = collect(rollup.bars(rollup.stored(spark, path), interval), "symbol", "ts")
        want = collect(ticks_to_bars(frame(spark, ticks), interval, order=("ts", "seq")), "symbol", "ts")
        pd.testing.assert_frame_equal(got[want.columns], want)
    assert rollup.stored(spark, path).agg(F.sum("ticks")).first()[0] == len(ticks)


def test_a_late_tick_touches_one_row_of_each_rollup_and_rewrites_no_file(spark, ticks):
    path = staging.new_path(spark, "rollup")
    sink = rollup.sink(path)
    sink(frame(spark, ticks), 0)
    before = {i: collect(rollup.bars(rollup.stored(spark, path), i), "symbol", "ts") for i in ("5m", "1h")}
    held = files(path + "/parts")
    late = ticks.iloc[[-60]].assign(seq=99_999, price=77.0, qty=1.0)
    too_late = ticks.iloc[:3].assign(seq=[90_001, 90_002, 90_003])
    sink(frame(spark, pd.concat([late, too_late])), 1)
    now = files(path + "/parts")
    assert all(now[f] == t for f, t in held.items()) and len(now) == len(held) + 1
    for interval, old in before.items():
        new = collect(rollup.bars(rollup.stored(spark, path), interval), "symbol", "ts")
        changed = new[(new != old).any(axis=1)]
        assert len(changed) == 1 and changed["high"].iloc[0] == 77.0
    assert sorted(r["seq"] for r in rollup.late_ticks(spark, path).collect()) == [90_001, 90_002, 90_003]


def test_a_refresh_merges_the_last_days_only(spark, ticks):
    path = staging.new_path(spark, "rollup")
    sink = rollup.sink(path, days=10)
    for i, part in enumerate(np.array_split(np.random.default_rng(2).permutation(len(ticks)), 4)):
        sink(frame(spark, ticks.iloc[part]), i)
    before, held = collect(rollup.stored(spark, path).select("symbol", "ts", "ticks"), "symbol", "ts", "ticks"), files(path + "/parts")
    rollup.refresh(spark, path, "2024-03-04 23:00:00", days=2)
    now = files(path + "/parts")
    added = [f for f in now if f not in held]
    assert all(now[f] == t for f, t in held.items())
    assert added and all(f"kind={rollup.MERGED}" in f and ("day=2024-03-0" in f) and "03-01" not in f for f in added)
    after = rollup.stored(spark, path)
    recent = after.filter("day >= '2024-03-02'")
    assert recent.count() == recent.select("symbol", "ts").distinct().count() < before[before["ts"] >= "2024-03-02"].shape[0]
    assert after.agg(F.sum("ticks")).first()[0] == len(ticks)
    # A batch that comes after the refresh still counts, and so does a second refresh.
    sink(frame(spark, ticks.iloc[[-1]].assign(seq=5000)), 4)
    rollup.refresh(spark, path, "2024-03-04 23:00:00", days=2)
    assert rollup.stored(spark, path).agg(F.sum("ticks")).first()[0] == len(ticks) + 1
