"""Result log, ranking and digest of evaluated runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import staging

# Fixed column set of a result row; rows may leave columns out.
SCHEMA = """
  run_id string, generation long, sharpe double, win_rate double, profit_factor double, total_pnl double,
  max_dd double, n_trades long, passes_gates boolean, rules_json string, config_json string, elapsed_bt double,
  llm_model string, llm_explanation string, llm_suggestions string, llm_confidence double,
  wf_sharpe double, wf_passes boolean, oos_sharpe double, oos_trades long, overfit boolean
"""


def append_results(rows: DataFrame, log_path: str) -> None:
    """Append result rows to the JSON-lines log."""
    rows.write.mode("append").json(log_path)


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    """All rows of the log, and the text of each line in ``line``.

    A value that does not convert to its column is NULL, columns beyond the fixed set stay in ``line``.  Lines
    that are no JSON object are not rows; ``broken_lines`` has them.
    """
    rows = _lines(spark, log_path).filter(_is_object())
    fields = T.StructType.fromDDL(SCHEMA)
    values = (F.try_variant_get("doc", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in fields)
    return rows.select(*values, F.col("value").alias("line"))


def broken_lines(spark: SparkSession, log_path: str) -> DataFrame:
    """The lines of the log that are no rows; blank ones are none."""
    return _lines(spark, log_path).filter(~_is_object() & (F.trim("value") != "")).select("value")


def _lines(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.text(log_path).select("value", F.try_parse_json("value").alias("doc"))


def _is_object() -> Column:
    return F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))


def compact(spark: SparkSession, log_path: str, table_path: str | None = None) -> DataFrame:
    """Rewrite the log as a Parquet table and return it."""
    path = table_path or staging.new_path(spark, "leaderboard")
    log = read_log(spark, log_path)
    log.write.mode("overwrite").parquet(path)
    return spark.read.schema(log.schema).parquet(path)


def add_rows(board: DataFrame, rows: DataFrame) -> DataFrame:
    """Union by name; columns missing on either side are NULL."""
    return board.unionByName(rows, allowMissingColumns=True)


def promising(board: DataFrame) -> DataFrame:
    return board.filter((F.col("sharpe") > 0) & (F.col("n_trades") >= 30))


def top(board: DataFrame, count: int = 10, min_sharpe: float = -999.0) -> DataFrame:
    """Best runs with at least one trade (top-k feature: sorted and limited)."""
    live = board.filter((F.col("n_trades") > 0) & (F.col("sharpe") >= min_sharpe))
    return live.orderBy(F.desc("sharpe"), "run_id").limit(count)


def top_per_group(board: DataFrame, group: Sequence[str], count: int = 3) -> DataFrame:
    """Best ``count`` runs of each group; Spark prunes per task before the shuffle."""
    best = Window.partitionBy(*group).orderBy(F.desc("sharpe"), "run_id")
    return board.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= count)


def _tested_out_of_sample() -> Column:
    return (F.col("oos_trades") >= 10) & ~F.coalesce(F.col("overfit"), F.lit(False))


def digest(board: DataFrame) -> DataFrame:
    """Counts and averages a progress report shows, as one row."""
    sharpe, ranked = F.col("sharpe"), F.col("n_trades") >= 10
    clean = ~F.coalesce(F.col("overfit"), F.lit(False))
    return board.agg(
        F.count(F.lit(1)).alias("n_tested"),
        F.count_if((sharpe > 0) & (F.col("n_trades") >= 30) & clean).alias("n_positive"),
        F.count_if(ranked).alias("n_ranked"),
        F.count_if(ranked & (sharpe > 0)).alias("n_ranked_positive"),
        F.avg(F.when(ranked, sharpe)).alias("mean_sharpe"),
        F.count_if(ranked & _tested_out_of_sample()).alias("n_oos_passed"),
        F.max(sharpe).alias("best_sharpe"),
        F.min_by("run_id", F.struct(-sharpe, F.col("run_id"))).alias("best_run"),
    )
