"""From raw documents to a training mix: each stage reads what the one before it kept.

Rows that repeat a doc_id stand or fall together in the filtering stages, and rows without a doc_id stay.  An empty table goes
through all stages; columns beside those of ``documents`` pass through the filtering stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, mixing, near_duplicates, toxicity
from tidemark.llm.tables import crc_mod, stage, table

#: Documents with this toxicity score or more go.
TOXIC = 0.3


def _without(docs: DataFrame, judged: DataFrame, good: F.Column) -> DataFrame:
    """The rows of ``docs`` whose id has a good row in ``judged``, and those without id."""
    rejected = judged.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max(good.cast("int")).alias("__good")).where("__good = 0")
    return docs.join(rejected, F.col("doc_id").cast("long") == F.col("__id"), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the positive-unlabelled classifiers score as toxic."""
    learnable = ~F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = toxicity.train(docs.where(learnable), table(spark, sf_dir, "labels").where(learnable))
    return toxicity.add_score(docs, model, "__toxicity").where(F.col("__toxicity") < TOXIC).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that repeat across documents; ``n_chars`` follows the new text."""
    out = line_dedup.drop_repeated_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies."""
    return _without(docs, near_duplicates.near_duplicates(docs), F.col("kept")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of which a twentieth or more is benchmark text."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found, ~decontaminate.contaminated()).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their words, their source's words and target, and the words the mix takes from them."""
    made = ("size", "source_size", "target", "taken")
    numbered = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    of = mixing.taken_by_row(numbered, row="__row").select(F.col("row").alias("__of"), *(F.col(c).alias(f"__{c}") for c in made))
    joined = numbered.join(of, F.col("__row") == F.col("__of"), "left")
    return joined.select(*(c for c in docs.columns if c not in made), *(F.col(f"__{c}").alias(c) for c in made))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mix", mix),
]

#: A learned classifier is not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
