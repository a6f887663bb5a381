"""Ancestor chains of strategies along their first parents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import staging


def first_parents(nodes: DataFrame) -> DataFrame:
    """``parent_ids`` (comma-joined string) as an array and its first entry as ``parent_id``."""
    ids = F.filter(F.split(F.coalesce("parent_ids", F.lit("")), ","), lambda p: p != "")
    return nodes.withColumn("parent_ids", ids).withColumn("parent_id", F.get("parent_ids", F.lit(0)))


def edges(nodes: DataFrame) -> DataFrame:
    """All parent links with their order."""
    return nodes.select("strategy_id", F.posexplode("parent_ids").alias("pos", "parent_id"))


def first_of_each(nodes: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One row per id: the first by ``order``, then by the other columns."""
    rest = [c for c in nodes.columns if c != "strategy_id" and c not in order]
    first = Window.partitionBy("strategy_id").orderBy(*order, *rest)
    return nodes.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def chains(nodes: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """``(strategy_id, hop, node)`` for every strategy, hop 0 being itself.

    Of rows that repeat an id the first (by ``order``) counts.  Unknown parents end a chain, as does the first
    node met again.  Path doubling: after step k a path holds 2**k nodes, one row per strategy; a path that has met
    its root or closed a circle is never written again.  A path of d nodes has d * d / 2 rows in the result, its own
    ancestors' included, so the paths stay short beside the result.
    """
    nodes = first_of_each(nodes, order)
    strategy = F.col("strategy_id")
    start = nodes.select(strategy, F.array(strategy).alias("path"), F.when(strategy != F.col("parent_id"), F.col("parent_id")).alias("to"))
    tables = [staging.save(start, "lineage-paths")]
    while not (growing := tables[-1].filter("to is not null")).isEmpty():
        settled = [t.filter("to is null") for t in tables]
        # Staged, as few ends are left after a few steps: then they are broadcast, and paths are not moved.
        ends = staging.save(growing.select("to").distinct(), "lineage-ends")
        lookup = reduce(DataFrame.unionByName, [*settled, growing]).toDF("end", "onward", "then")
        met = staging.save(lookup.join(ends, F.col("end") == F.col("to"), "left_semi"), "lineage-met")
        path = F.when(F.col("onward").isNull(), F.col("path")).otherwise(F.array_union("path", "onward"))
        longer = growing.join(met, F.col("to") == F.col("end"), "left").select("strategy_id", path.alias("path"), "then")
        goes_on = F.when(~F.array_contains("path", F.col("then")), F.col("then"))
        tables.append(staging.save(longer.select("strategy_id", "path", goes_on.alias("to")), "lineage-paths"))
    paths = reduce(DataFrame.unionByName, [t.filter("to is null") for t in tables])
    return paths.select("strategy_id", F.posexplode("path").alias("hop", "node")).withColumn("hop", F.col("hop").cast("long"))


def chain_of(nodes: DataFrame, strategy_id, order: Sequence[str] = ()) -> DataFrame:
    """The chain of one strategy."""
    return chains(nodes, order).filter(F.col("strategy_id") == strategy_id).select("hop", "node")
