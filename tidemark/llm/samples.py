"""Bounded samples of labelled rows for fitting small models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Draws are 62-bit numbers, so that a share of one row in billions still gets its rows.
DRAWS = 1 << 62


def draw(seed: int, *columns: str) -> F.Column:
    """A pseudorandom number below ``DRAWS`` that follows from the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(DRAWS))


def threshold(bound: int, rows: int) -> int:
    """What draws stay below for about ``bound`` of ``rows`` rows."""
    return DRAWS if rows <= bound else DRAWS * bound // rows


def sample_rows(rows: DataFrame, key: str, bound: int, label: str, seed: int) -> DataFrame:
    """About ``bound`` rows per value of ``label``, chosen by a hash of ``key``; all rows where there are fewer.

    The same rows are chosen in every run.  ``label`` must have few values.
    """
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | (F.col(label).eqNullSafe(F.lit(value)) & (draw(seed, key) < threshold(bound, n)))
    return rows.where(keep)


def distinct_texts(rows: DataFrame, bound: int, seed: int) -> DataFrame:
    """At most ``bound`` of the distinct ``(id, text)`` pairs among sampled rows: repeats of a row, however many, count once."""
    once = rows.select("id", "text").dropDuplicates(["id", "text"])
    return once.orderBy(F.xxhash64(F.lit(seed), "id", "text"), "id", "text").limit(bound)


def one_label(labels: DataFrame, id_column: str, column: str) -> DataFrame:
    """One 0/1 label per id: rows without one are out, and of conflicting ones the larger counts."""
    return (
        labels.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("int").alias("label"))
        .where("id is not null and label in (0, 1)")
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
