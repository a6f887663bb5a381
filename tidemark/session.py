"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark import cloudpickle
from pyspark.sql import SparkSession

from tidemark.plans.series import chunk_rows

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings that results depend on; leave sizing to the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # Windows run over chunks of bounded size, so a whole chunk may stay in memory.
    spark.conf.set("spark.sql.windowExec.buffer.in.memory.threshold", str(2 * chunk_rows(spark)))
    _ship_package()
    return spark


def _ship_package() -> None:
    """Send this package's functions to the Python workers by value.

    Workers then need no copy of the package, nor does the helper process that prepares
    stateful stream operators, which does not see files added to the context.
    """
    import tidemark

    cloudpickle.register_pickle_by_value(tidemark)


def local_session(cores: int | str = 8, name: str = "tidemark", checkpoint_dir: str | None = None) -> SparkSession:
    """A single-JVM session for tests and the bench; only here may the checkpoint folder be a local one."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", checkpoint_dir or tempfile.mkdtemp(prefix=f"{name}-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
