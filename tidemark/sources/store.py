"""Month-partitioned tables with keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import staging
from tidemark.functions.intervals import month_of

PARTITION_TYPES_CONF = "spark.sql.sources.partitionColumnTypeInference.enabled"
BAR_SCHEMA = T.StructType(
    [
        T.StructField("exchange", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")),
    ]
)


def normalise_bars(rows: DataFrame, exchange: str = "") -> DataFrame:
    """Bar columns with the stored types; names in lower case as the store keys them."""
    if "exchange" not in rows.columns:
        rows = rows.withColumn("exchange", F.lit(exchange))
    typed = rows.select(*(F.col(f.name).cast(f.dataType) for f in BAR_SCHEMA))
    return typed.withColumns({k: F.lower(k) for k in ("exchange", "symbol")})


def feature_types(rows: DataFrame) -> DataFrame:
    """Floats as double, integers as long, timestamps as they are, anything else as text."""
    def stored(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.col(f.name).cast("timestamp")
        if isinstance(f.dataType, T.FractionalType):
            return F.col(f.name).cast("double")
        if isinstance(f.dataType, T.IntegralType):
            return F.col(f.name).cast("long")
        return F.col(f.name).cast("string")

    return rows.select(*(stored(f).alias(f.name) for f in rows.schema))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the table was written before."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(target) and len(files.listStatus(target)) > 0


def read(
    spark: SparkSession, path: str, schema: T.StructType | None = None, merge_schema: bool = False
) -> DataFrame | None:
    """The table, or None if nothing was written yet.

    ``merge_schema`` opens every footer; only tables whose columns grow need it.
    """
    if not exists(spark, path):
        return None
    # Folder names are the text they were written as: "007" must not come back as 7.
    spark.conf.set(PARTITION_TYPES_CONF, "false")
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", merge_schema)
    return reader.parquet(path)


NANOS_CONF = "spark.sql.legacy.parquet.nanosAsLong"


def read_nanos(spark: SparkSession, path: str, times: Sequence[str] = ("ts",)) -> DataFrame:
    """Files written elsewhere with times in nanoseconds, which Spark does not read as times: whole microseconds remain."""
    before = spark.conf.get(NANOS_CONF)
    spark.conf.set(NANOS_CONF, "true")
    try:
        rows = spark.read.parquet(path)
        types = dict(rows.dtypes)
    finally:
        spark.conf.set(NANOS_CONF, before)
    rows = spark.read.option("nanosAsLong", "true").schema(rows.schema).parquet(path)
    return rows.withColumns({c: F.timestamp_micros(F.floor(F.col(c) / 1000)) for c in times if types.get(c) == "bigint"})


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of each key in the given order (pruned per task before the shuffle)."""
    newest = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def _only_partitions(table: DataFrame, touched: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Rows of the touched partitions.

    The names stay in a join; its filter lets Spark prune all other folders at run time.
    """
    names = touched.select(*parts).distinct().filter(F.col("month") > "")
    return table.join(names, list(parts), "left_semi")


def settled(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> list[str]:
    """A total order of the rows of a key: the given one, then all other columns, so that no choice is left to chance."""
    plain = [f.name for f in rows.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return [*order, *(c for c in plain if c not in keys and c not in order)]


def upsert(
    rows: DataFrame,
    path: str,
    keys: Sequence[str] = ("exchange", "symbol", "ts"),
    partitions: Sequence[str] = ("exchange",),
    order: Sequence[str] = (),
    merge_schema: bool = False,
) -> int:
    """Merge ``rows`` into the table by key, new rows winning; ``order`` ranks rows inside the batch.

    Rows equal in ``order`` are ranked by their other columns, the larger winning.  Columns that are in
    ``order`` only to rank (not in the stored table) are dropped.  Only the months the batch touches are read and rewritten.  Returns the rows now in them.
    Symbols are a sort order inside a month rather than folders: files stay large with many
    symbols, an even share of rows each, and their statistics still prune a single symbol.
    """
    spark, parts = rows.sparkSession, [*partitions, "month"]
    # The batch is read several times; staged, its plan runs once.
    named = rows.withColumns({"month": month_of(F.col("ts")), **{p: F.col(p).cast("string") for p in partitions}})
    batch = staging.save(named, "batch").withColumn("_batch", F.lit(1))
    if batch.isEmpty():
        return 0
    ranked = latest(batch, keys, settled(rows, keys, order)).drop(*order)
    touched = batch.select(*parts).distinct()
    old = read(spark, path, merge_schema=merge_schema)
    if old is not None:
        stored = _only_partitions(old, touched, parts).withColumn("_batch", F.lit(0))
        ranked = latest(stored.unionByName(ranked, allowMissingColumns=True), keys, ["_batch"])
    layout = [*parts, *(k for k in keys if k not in parts)]
    (
        ranked.drop("_batch")
        .repartitionByRange(*layout)
        .sortWithinPartitions(*layout)
        .write.mode("overwrite")
        .partitionBy(*parts)
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )
    return _only_partitions(read(spark, path), touched, parts).count()


def insert_ignore(
    rows: DataFrame, path: str, keys: Sequence[str] = ("symbol", "ts"), order: Sequence[str] = ()
) -> DataFrame:
    """Append rows whose key the table lacks, the first one per key; returns the appended rows.

    First is by ``order``, then by the other columns.

    The last key is the time: stored files outside the batch's time range are skipped by
    their statistics.
    """
    spark, time = rows.sparkSession, keys[-1]
    first = Window.partitionBy(*keys).orderBy(*settled(rows, keys, order))
    fresh = rows.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")
    fresh = staging.save(fresh, "insert")
    old = read(spark, path)
    if old is not None:
        timed = isinstance(fresh.schema[time].dataType, T.TimestampType)
        number, at = (F.unix_micros, F.timestamp_micros) if timed else (F.col, lambda c: c)
        lo, hi = fresh.agg(F.min(number(time)), F.max(number(time))).first()
        known = old.filter(F.col(time).between(at(F.lit(lo)), at(F.lit(hi)))).select(*keys)
        fresh = fresh.join(known, list(keys), "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh


def scan(
    table: DataFrame, start=None, end=None, keys: Sequence[str] = ("exchange", "symbol", "ts"), dedup: Sequence[str] = ()
) -> DataFrame:
    """Rows between inclusive UTC bounds; whole months outside them are never opened.

    Upserts leave keys unique; for appended tables ``dedup`` names the order whose last row is kept.
    """
    for bound, month_ok, ts_ok in (
        (start, lambda m, b: m >= b, lambda t, b: t >= b),
        (end, lambda m, b: m <= b, lambda t, b: t <= b),
    ):
        if bound is not None:
            at = F.lit(bound).cast("timestamp")
            if "month" in table.columns:
                table = table.filter(month_ok(F.col("month"), month_of(at)))
            table = table.filter(ts_ok(F.col("ts"), at))
    return latest(table, keys, dedup) if dedup else table


def coverage(table: DataFrame, keys: Sequence[str] = ("exchange", "symbol")) -> DataFrame:
    """Row count, first and last time per key, from the ``ts`` column alone."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def new_rows(
    rows: DataFrame, stored: DataFrame, keys: Sequence[str] = ("symbol",), step: str = "INTERVAL 60 SECONDS"
) -> DataFrame:
    """Rows later than what is stored for their key by at least ``step``; all rows of unknown keys."""
    marks = stored.groupBy(*keys).agg(F.max("ts").alias("_mark"))
    fresh = F.col("_mark").isNull() | (F.col("ts") >= F.col("_mark") + F.expr(step))
    return rows.join(marks, list(keys), "left").filter(fresh).drop("_mark")
