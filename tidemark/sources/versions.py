"""Tables that grow by appended versions, are merged on reading and compacted month by month.

``store.upsert`` rewrites the months a batch touches.  Here a batch becomes one new version and no stored file changes:

* ``data/v<n>/month=<m>``: the rows of version ``n``, unique by key, sorted by key;
* ``cells/v<n>``: a row per day and key without the time: rows, rows whose key no older version has, first and last time;
* ``log``: a row per version and month with the columns it was written with and the versions it replaces there.

A version counts from its log row on, which is written last: what a failed append leaves behind is not read, and the next
append overwrites it.  One writer at a time.  The driver holds the log, a row per (version, month); ``compact`` keeps it short.
Questions about extent and columns are answered from cells and log, without opening a data file or a footer.

The last key is the time.  Rows without a time lie in month ``none``; null keys are equal to each other.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import staging
from tidemark.functions.intervals import month_of
from tidemark.sources.store import exists, latest, settled

KEYS = ("exchange", "symbol", "ts")
NO_MONTH = "none"
LOG_SCHEMA = "version long, month string, replaces array<long>, columns string, batch string"
Live = dict[str, list[int]]


def _log(spark: SparkSession, path: str) -> list:
    if not exists(spark, f"{path}/log"):
        return []
    return sorted(spark.read.schema(LOG_SCHEMA).parquet(f"{path}/log").collect(), key=lambda r: (r.version, r.month))


def _live(log: Sequence) -> Live:
    """The versions that count in each month, oldest first."""
    gone = {(v, r.month) for r in log for v in r.replaces}
    out = defaultdict(list)
    for r in log:
        if (r.version, r.month) not in gone:
            out[r.month].append(r.version)
    return dict(out)


def _columns(log: Sequence) -> T.StructType:
    """All columns of all versions, in the order they first came; a column keeps one type."""
    out: dict[str, T.StructField] = {}
    for r in log:
        for f in T.StructType.fromJson(json.loads(r.columns)):
            if out.setdefault(f.name, f).dataType != f.dataType:
                raise ValueError(f"column {f.name} was {out[f.name].dataType.simpleString()} and is {f.dataType.simpleString()} in version {r.version}")
    return T.StructType(list(out.values()))


def columns(spark: SparkSession, path: str) -> T.StructType:
    """The table's columns, from the log alone."""
    return _columns(_log(spark, path))


def _month(time: str) -> Column:
    return F.coalesce(month_of(F.col(time)), F.lit(NO_MONTH))


def _files(spark: SparkSession, path: str, live: Live, schema: T.StructType) -> DataFrame:
    """Rows of the listed versions with ``_version``; the given columns spare Spark all footers."""
    folders = [f"{path}/data/v{v}/month={m}" for m, versions in sorted(live.items()) for v in versions]
    wide = T.StructType([*schema, T.StructField("_version", T.LongType())])
    return spark.read.schema(wide).parquet(*folders) if folders else spark.createDataFrame([], wide)


def _cells(spark: SparkSession, path: str, live: Live) -> DataFrame | None:
    versions = sorted({v for vs in live.values() for v in vs})
    if not versions:
        return None
    rows = spark.read.parquet(*(f"{path}/cells/v{v}" for v in versions))
    pairs = spark.createDataFrame([(m, v) for m, vs in live.items() for v in vs], "month string, _version long")
    return rows.join(pairs, ["month", "_version"], "left_semi")


def _by_cell(rows: DataFrame, cells: DataFrame, names: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join of rows with cells (key prefix and day), null equal to null."""
    dated = rows.withColumn("_day", F.to_date(names[-1]))
    named = cells.select(*(F.col(c).alias(f"_{c}") for c in names[:-1]), F.col("day").alias("_cell_day"))
    same = F.col("_day").eqNullSafe(F.col("_cell_day"))
    for c in names[:-1]:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return dated.join(named, same, how).drop("_day")


def _write(rows: DataFrame, path: str, version: int, keys: Sequence[str]) -> DataFrame:
    """Write the rows of a version; returns a scan of them with ``month``."""
    spark, at = rows.sparkSession, f"{path}/data/v{version}"
    dated = rows.withColumns({"month": _month(keys[-1]), "_version": F.lit(version).cast("long")})
    dated.repartitionByRange("month", *keys).sortWithinPartitions("month", *keys).write.mode("overwrite").partitionBy("month").parquet(at)
    plain = T.StructType([f for f in dated.schema if f.name != "month"])
    return spark.read.schema(plain).parquet(at + "/month=*").withColumn("month", _month(keys[-1]))


def _commit(written: DataFrame, fresh: DataFrame, path: str, version: int, keys: Sequence[str], replaces: Live, schema: T.StructType, batch) -> None:
    """Write cells, then the log row of each month."""
    spark, time = written.sparkSession, keys[-1]
    by = ["month", *keys[:-1], "day"]
    counted = written.withColumns({"day": F.to_date(time), "_new": F.lit(0)}).select(*by, time, "_new")
    added = fresh.withColumns({"day": F.to_date(time), "_new": F.lit(1)}).select(*by, time, "_new")
    cells = counted.unionByName(added).groupBy(*by).agg(
        F.sum(1 - F.col("_new")).alias("rows"), F.sum("_new").alias("added"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts")
    )
    at = f"{path}/cells/v{version}"
    cells.withColumn("_version", F.lit(version).cast("long")).write.mode("overwrite").parquet(at)
    months = sorted(r.month for r in spark.read.parquet(at).select("month").distinct().collect())
    rows = [(version, m, replaces.get(m, []), schema.json(), batch) for m in months]
    spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/log")


def append(rows: DataFrame, path: str, keys: Sequence[str] = KEYS, order: Sequence[str] = (), batch: str | None = None) -> int | None:
    """Add ``rows`` as a new version whose rows win over older ones of their key; returns its number, None if it has no rows.

    ``order`` ranks rows inside the batch as in ``store.upsert``.  A batch whose name is in the log is not added again, so a
    sink may repeat it.  Older files are read only where a day of a key has rows in both, to count keys that are new.
    """
    spark, time = rows.sparkSession, keys[-1]
    log = _log(spark, path)
    if batch is not None and any(r.batch == batch for r in log):
        return None
    staged = staging.save(rows, "version")
    if staged.isEmpty():
        return None
    version, live = max((r.version for r in log), default=0) + 1, _live(log)
    unique = latest(staged, keys, settled(staged, keys, order)).drop(*order)
    _columns([*log, Row(version=version, columns=unique.schema.json())])
    written = fresh = _write(unique, path, version, keys)
    older = _cells(spark, path, live)
    if older is not None:
        touched = _by_cell(older.withColumn(time, F.col("first_ts")), written.select(*keys[:-1], F.to_date(time).alias("day")).distinct(), keys, "left_semi")
        touched = staging.save(touched.select("month", *keys[:-1], "day").distinct(), "touched")
        months = {r.month for r in touched.select("month").distinct().collect()}
        if months:
            stored = _files(spark, path, {m: live[m] for m in months}, _columns(log))
            known = _by_cell(stored, touched, keys, "left_semi").select(*(F.col(k).alias(f"_{k}") for k in keys))
            same = F.lit(True)
            for k in keys:
                same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
            fresh = written.join(known, same, "left_anti")
    _commit(written, fresh, path, version, keys, {}, unique.schema, batch)
    return version


def _merged(spark: SparkSession, path: str, live: Live, schema: T.StructType, keys: Sequence[str], bounds: Column | None = None) -> DataFrame:
    def bounded(rows):
        return rows if bounds is None else rows.filter(bounds)

    single = {m: vs for m, vs in live.items() if len(vs) == 1}
    several = {m: vs for m, vs in live.items() if len(vs) > 1}
    plain = bounded(_files(spark, path, single, schema))
    if not several:
        return plain.drop("_version")
    rows = bounded(_files(spark, path, several, schema))
    shared = _cells(spark, path, several).groupBy(*keys[:-1], "day").agg(F.count("*").alias("_n")).filter("_n > 1")
    newest = latest(_by_cell(rows, shared, keys, "left_semi"), keys, ["_version"])
    alone = _by_cell(rows, shared, keys, "left_anti")
    return plain.unionByName(alone).unionByName(newest).drop("_version")


def read(spark: SparkSession, path: str, start=None, end=None, keys: Sequence[str] = KEYS) -> DataFrame | None:
    """The newest row of each key, between inclusive UTC bounds if given; None if nothing was written yet.

    Only days of a key that lie in more than one version are shuffled; months outside the bounds are not opened.
    """
    log = _log(spark, path)
    if not log:
        return None
    live, bounds = _live(log), None
    for value, month_ok, ts_ok in ((start, lambda m, b: m >= b, lambda t, b: t >= b), (end, lambda m, b: m <= b, lambda t, b: t <= b)):
        if value is not None:
            at = F.lit(value).cast("timestamp")
            month = spark.range(1).select(month_of(at)).first()[0]
            live = {m: vs for m, vs in live.items() if m != NO_MONTH and month_ok(m, month)}
            ok = ts_ok(F.col(keys[-1]), at)
            bounds = ok if bounds is None else bounds & ok
    return _merged(spark, path, live, _columns(log), keys, bounds)


def compact(spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> int | None:
    """Merge the versions of each month that has several into one new version; other months are not read.

    Replaced files stay until ``vacuum``, so readers that planned before are not disturbed.
    """
    log = _log(spark, path)
    several = {m: vs for m, vs in _live(log).items() if len(vs) > 1}
    if not several:
        return None
    version, schema = max(r.version for r in log) + 1, _columns(log)
    written = _write(_merged(spark, path, several, schema, keys), path, version, keys)
    _commit(written, written, path, version, keys, several, schema, None)
    return version


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the files of replaced versions; returns how many (version, month) folders went."""
    log = _log(spark, path)
    gone = sorted({(v, r.month) for r in log for v in r.replaces})
    for v, m in gone:
        staging.drop(spark, f"{path}/data/v{v}/month={m}")
    return len(gone)


def coverage(spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> DataFrame | None:
    """``store.coverage`` of the merged table from its cells: no data file is opened."""
    cells = _cells(spark, path, _live(_log(spark, path)))
    if cells is None:
        return None
    return cells.groupBy(*keys[:-1]).agg(F.sum("added").alias("rows"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
