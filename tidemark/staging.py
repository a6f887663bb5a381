"""Intermediate tables in the shared folder the cluster names.

A staged table cuts lineage: it survives the loss of any executor, keeps Parquet
column pruning for its readers, and fixes the outcome of a range partitioning, so
that several branches of one plan see the same row positions.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def root(spark: SparkSession) -> str:
    """The shared folder the session names; there is no other."""
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors can reach")
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{root(spark)}/tidemark/{app}/{label}-{uuid.uuid4().hex[:12]}"


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("error").parquet(path)
    for made in _scopes.get():
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Drop the tables staged inside the block once it ends; results must be written by then.

    Long-running streams stage per micro-batch and would otherwise fill the folder.
    """
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in made:
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
