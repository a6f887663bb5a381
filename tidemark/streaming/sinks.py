"""Micro-batch sinks: idempotent by batch id or by key, with tails carried between batches."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import staging
from tidemark.operators import trailing
from tidemark.operators.indicators import add_all
from tidemark.operators.resample import BAR
from tidemark.plans.features import increment, write_features
from tidemark.plans.series import index_rows
from tidemark.sources import store

log = logging.getLogger(__name__)


def drain(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, timeout_s: int | None = None) -> None:
    """Process everything available and stop; batches failed half-way are repeated."""
    query = stream.writeStream.foreachBatch(scoped(process)).option("checkpointLocation", checkpoint)
    _finish(query.trigger(availableNow=True).start(), timeout_s)


def scoped(process: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """The sink, leaving no staged tables behind after a batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        with staging.scope(batch.sparkSession):
            process(batch, batch_id)

    return run


def drain_to_table(stream: DataFrame, path: str, checkpoint: str, timeout_s: int | None = None) -> None:
    """Append a stateless or append-mode stream to a Parquet table exactly once."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    _finish(query.trigger(availableNow=True).start(), timeout_s)


def _finish(query: StreamingQuery, timeout_s: int | None = None) -> None:
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"stream still running after {timeout_s} s")


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Rows of one batch under their own partition, so that a repeated batch replaces itself."""
    rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").partitionBy("batch_id").option(
        "partitionOverwriteMode", "dynamic"
    ).parquet(path)


class Tail:
    """Recent rows per key, kept as one small table per batch for the next one to read."""

    def __init__(self, path: str, window_ms: int, keys: Sequence[str] = ("symbol",)):
        self.path, self.window_ms, self.keys = path, window_ms, list(keys)

    def with_tail(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The batch (``_new`` true) after the rows still inside the window of its predecessor."""
        spark = batch.sparkSession
        new = staging.save(batch.withColumn("_new", F.lit(True)), "microbatch")
        before = f"{self.path}/{batch_id - 1}"
        if not store.exists(spark, before):
            return new
        return new.unionByName(spark.read.schema(batch.schema).parquet(before).withColumn("_new", F.lit(False)))

    def keep(self, rows: DataFrame, batch_id: int) -> None:
        newest = rows.groupBy(*self.keys).agg(F.max("ts_ms").alias("_newest"))
        inside = F.col("ts_ms") >= F.col("_newest") - self.window_ms
        rows.join(newest, self.keys).filter(inside).drop("_newest", "_new").write.mode("overwrite").parquet(
            f"{self.path}/{batch_id}"
        )
        # A batch may be repeated, and then needs its predecessor; older tails are done with.
        staging.drop(rows.sparkSession, f"{self.path}/{batch_id - 2}")


def trailing_sink(
    operator: Callable[..., DataFrame], path: str, state: str, tail_ms: int, **options
) -> Callable[[DataFrame, int], None]:
    """Run a trailing-window operator over a stream; results equal the batch operator on sorted input."""
    tail = Tail(state, tail_ms)

    def process(batch: DataFrame, batch_id: int) -> None:
        rows = tail.with_tail(batch, batch_id)
        write_batch(operator(rows, keep=["_new"], **options).filter("_new").drop("_new"), path, batch_id)
        tail.keep(rows, batch_id)

    return process


def closed_bar_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each closed candle once, in its first closed version (order: batch, then ``seq``)."""

    def process(batch: DataFrame, batch_id: int) -> None:
        store.insert_ignore(batch.filter("is_closed"), path, ("symbol", "open_time_ms"), ("seq",))

    return process


def rollup_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Latest version of every bucket of an update-mode rollup."""

    def process(batch: DataFrame, batch_id: int) -> None:
        store.upsert(batch, path, ("symbol", "ts"), ())

    return process


def feature_sink(bars_path: str, features_path: str) -> Callable[[DataFrame, int], None]:
    """Features of new bars, equal to a full rebuild however the bars are cut into batches.

    Stored bars and features give the context, by the same code as a batch build.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = staging.save(batch.select("symbol", "ts", *BAR), "microbatch")
        stored, features = store.read(spark, bars_path), store.read(spark, features_path, merge_schema=True)
        if stored is not None:
            rows = rows.unionByName(stored.select("symbol", "ts", *BAR).join(rows, ["symbol", "ts"], "left_anti"))
        rows = staging.save(rows, "bars-so-far")
        done = add_all(index_rows(rows)).drop("rn", "n") if features is None else increment(rows, features)
        write_features(done, features_path)

    return process


def bar_sinks(sinks: Mapping[str, Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """Fan a batch out to several idempotent sinks.

    One failing does not keep the others from running; the batch then fails, and is repeated for all of them.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        failures = []
        for name, sink in sinks.items():
            try:
                sink(batch, batch_id)
            except Exception as e:
                log.exception("sink %s failed on batch %s", name, batch_id)
                failures.append((name, e))
        if failures:
            raise RuntimeError(f"batch {batch_id}: sinks failed: {', '.join(n for n, _ in failures)}") from failures[0][1]

    return process


def upsert_sink(path: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, batch_id: store.upsert(store.normalise_bars(batch), path) and None


def copy_sink(path: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, batch_id: store.insert_ignore(batch.select("symbol", "ts", *BAR), path) and None


def snapshot_sink(path: str, state: str, bars: DataFrame, return_ms: int = 30_000, short_ms: int = 60_000, long_ms: int = 300_000,
                  bar_ms: int = 60_000) -> Callable[[DataFrame, int], None]:
    """Latest state per symbol: price and return, flow, and its candles.  The newest version is ``path/<batch>``."""
    tail = Tail(state, max(return_ms, long_ms))

    def process(batch: DataFrame, batch_id: int) -> None:
        spark, before = batch.sparkSession, f"{path}/{batch_id - 1}"
        rows = tail.with_tail(batch, batch_id)
        now = store.latest(trailing.trailing_return(rows, return_ms), ["symbol"], ["ts_ms", "seq"]).drop("ticks")
        flow = store.latest(trailing.trailing_flow(rows, short_ms, long_ms), ["symbol"], ["ts_ms", "seq"])
        state_now = now.join(flow.drop("ts_ms", "seq"), "symbol").join(candle_state(bars, bar_ms), "symbol", "left")
        state_now = state_now.withColumn("_version", F.lit(1))
        if store.exists(spark, before):
            old = spark.read.parquet(before).withColumn("_version", F.lit(0))
            state_now = store.latest(old.unionByName(state_now), ["symbol"], ["_version"])
        state_now.drop("_version").write.mode("overwrite").parquet(f"{path}/{batch_id}")
        tail.keep(rows, batch_id)

    return process


def candle_state(bars: DataFrame, bar_ms: int) -> DataFrame:
    """Volume of the latest candle, closed candles held, and gaps seen, per symbol."""
    series = index_rows(bars)
    gaps = trailing.bar_gaps(series, bar_ms).groupBy("symbol").agg(F.count(F.lit(1)).alias("gaps"))
    candles = series.groupBy("symbol").agg(
        F.max_by("volume", "rn").alias("volume"), F.count(F.lit(1)).alias("candles_ready")
    )
    return candles.join(gaps, "symbol", "left").fillna(0, ["gaps"])


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the state."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    names = (f.getPath().getName() for f in files.listStatus(target))
    return spark.read.parquet(f"{path}/{max(int(n) for n in names if n.isdigit())}")
