"""Append-only tables of runs, fingerprints, lineage nodes and rule documents."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import store


def _replace_runs(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("run_id").option("partitionOverwriteMode", "dynamic").parquet(path)


def save_run(
    trades: DataFrame, summary: DataFrame, path: str, run_id: str, strategy: str, config: Mapping, run_at=None
) -> None:
    """Trades and summary of a run under its id; saving a run again replaces it.

    The configuration is kept as a JSON string beside the summary.
    """
    at = F.current_timestamp() if run_at is None else F.lit(run_at).cast("timestamp")
    text = F.lit(json.dumps(dict(config), default=str))
    named = summary.withColumns({"strategy": F.lit(strategy), "config": text, "run_at": at})
    _replace_runs(trades.withColumn("run_id", F.lit(run_id)), f"{path}/trades")
    _replace_runs(named.withColumn("run_id", F.lit(run_id)), f"{path}/summary")


def read_run(spark: SparkSession, path: str, part: str = "summary") -> DataFrame | None:
    return store.read(spark, f"{path}/{part}", merge_schema=True)


def record_fingerprints(rules: DataFrame, path: str) -> None:
    """Append ``fp`` and rule name to the log of rules tried."""
    rules.select("fp", "name", F.current_timestamp().alias("ts")).write.mode("append").json(path)


def seen_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Distinct fingerprints of the log; only lines that are no JSON are skipped."""
    if not store.exists(spark, path):
        return spark.createDataFrame([], "fp string")
    fp = F.try_variant_get(F.try_parse_json("value"), "$.fp", "string")
    return spark.read.text(path).select(fp.alias("fp")).filter("fp IS NOT NULL").distinct()


def add_nodes(nodes: DataFrame, path: str) -> None:
    """Append lineage nodes."""
    nodes.write.mode("append").parquet(path)


def write_resampled(bars: DataFrame, path: str, interval: str) -> None:
    """Resampled bars under their interval, range-sorted by symbol and time; replaces that interval only."""
    (
        bars.withColumn("interval", F.lit(interval))
        .repartitionByRange("symbol", "ts")
        .sortWithinPartitions("symbol", "ts")
        .write.mode("overwrite")
        .partitionBy("interval")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def write_documents(documents: DataFrame, path: str, column: str = "document") -> None:
    """Append rule documents, one JSON text per line."""
    documents.select(F.col(column).alias("value")).write.mode("append").text(path)
