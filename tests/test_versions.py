"""Appended versions against the upserting store, and what is read and written on the way."""

import random
from datetime import datetime, timedelta

from tidemark import staging
from tidemark.sources import store, versions

START = datetime(2026, 4, 29)
SCHEMA = "exchange string, symbol string, ts timestamp, close double"


def batch(spark, seed, n=400):
    rng = random.Random(seed)
    rows = [(rng.choice("xy"), rng.choice("abc"), START + timedelta(minutes=17 * rng.randrange(400)), round(rng.random() * 9, 3)) for _ in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted((r.exchange, r.symbol, str(r.ts), r.close) for r in df.collect())


def files(spark, path):
    """Name, length and time of each data file."""
    home = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    found, out = home.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(home, True), set()
    while found.hasNext():
        f = found.next()
        if f.getPath().getName().endswith(".parquet"):
            out.add((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return out


def test_versions_equal_upserts_before_and_after_compaction(spark):
    path, plain = staging.new_path(spark, "v"), staging.new_path(spark, "u")
    assert versions.read(spark, path) is None and versions.coverage(spark, path) is None and versions.compact(spark, path) is None
    for seed in range(3):
        rows = batch(spark, seed)
        assert versions.append(rows, path) == seed + 1
        store.upsert(rows, plain)
    want = store.read(spark, plain)
    span = ("2026-04-30 12:00:00", "2026-05-02 06:00:00")

    def equal():
        assert rows_of(versions.read(spark, path)) == rows_of(want)
        assert rows_of(versions.read(spark, path, *span)) == rows_of(store.scan(want, *span))
        assert sorted(versions.coverage(spark, path).collect()) == sorted(store.coverage(want).collect())

    equal()
    assert versions.compact(spark, path) == 4 and versions.compact(spark, path) is None
    late = batch(spark, 9, 50)
    versions.append(late, path)
    store.upsert(late, plain)
    want = store.read(spark, plain)
    equal()
    assert versions.vacuum(spark, path) == 6
    equal()


def test_one_bar_rewrites_no_stored_file_and_compaction_only_its_month(spark):
    path = staging.new_path(spark, "v")
    versions.append(batch(spark, 1), path)
    before = files(spark, path)
    versions.append(spark.createDataFrame([("x", "a", datetime(2026, 5, 2), 1.5)], SCHEMA), path)
    after = files(spark, path)
    assert before < after and len(after) == len(before) + 1
    versions.compact(spark, path)
    assert after < files(spark, path)
    assert all("month=2026-05" in name for name, *_ in files(spark, path) - after)
    assert not any("month=2026-05/" in f and "/v3/" not in f for f in versions.read(spark, path).inputFiles())


def test_extent_and_columns_open_no_data_file(spark):
    path = staging.new_path(spark, "v")
    versions.append(batch(spark, 1), path)
    versions.append(batch(spark, 2).selectExpr("*", "close + 1 AS high"), path)
    assert all("/cells/" in f for f in versions.coverage(spark, path).inputFiles())
    assert versions.columns(spark, path).names == ["exchange", "symbol", "ts", "close", "high"]
    table = versions.read(spark, path)
    assert table.columns == ["exchange", "symbol", "ts", "close", "high"]
    assert 0 < table.filter("high is null").count() < table.count()
    assert all("2026-05" in f for f in versions.read(spark, path, start="2026-05-01").inputFiles() if "/data/" in f)


def test_repeats_failures_nulls_and_empty_batches(spark):
    path = staging.new_path(spark, "v")
    odd = spark.createDataFrame([(None, "a", None, 1.0), (None, "a", None, 2.0), ("x", None, START, 3.0)], SCHEMA)
    assert versions.append(odd, path, batch="7") == 1
    assert versions.append(odd, path, batch="7") is None
    assert versions.append(odd.limit(0), path) is None
    # an append that ended before its log row leaves files that nobody reads and the next one overwrites
    versions._write(batch(spark, 3), path, 2, versions.KEYS)
    assert rows_of_any(versions.read(spark, path)) == [("None", "a", "None", 2.0), ("x", "None", str(START), 3.0)]
    assert versions.append(odd.filter("ts is null").selectExpr("exchange", "symbol", "ts", "close + 5 AS close"), path) == 2
    assert rows_of_any(versions.read(spark, path)) == [("None", "a", "None", 7.0), ("x", "None", str(START), 3.0)]
    assert sum(r.rows for r in versions.coverage(spark, path).collect()) == 2
    versions.compact(spark, path)
    assert rows_of_any(versions.read(spark, path)) == [("None", "a", "None", 7.0), ("x", "None", str(START), 3.0)]


def rows_of_any(df):
    return sorted((str(r.exchange), str(r.symbol), str(r.ts), r.close) for r in df.collect())
