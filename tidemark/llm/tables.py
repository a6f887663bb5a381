"""Small helpers the operators share: reading tables, staging, fixed-size membership filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import staging
from tidemark.session import configure

#: Bits of a membership filter.  The filter is always this size (2 MB), whatever it holds: with more keys it
#: lets more strangers through, which costs time and never changes a result.
FILTER_BITS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read it back: cuts lineage and survives lost executors."""
    return staging.save(df, label)


def crc_mod(id_column: str, divisor: int) -> F.Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(divisor))


def membership(df: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap over the top bits of 64-bit ``column``; at most ``2 ** (bits - 6)`` rows reach the driver."""
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    rows = (
        df.where(F.col(column).isNotNull())
        .select(slot.alias("slot"))
        .select(F.expr("slot div 64").alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["word"].to_numpy()] = rows["bit"].to_numpy()
    return out.view(np.uint8)


def passes(bitmap: np.ndarray, hashes: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    """Positions in ``hashes`` (64-bit) that may be in the filter."""
    slot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return np.flatnonzero(bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
