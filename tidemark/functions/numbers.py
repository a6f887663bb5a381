"""Small numeric Column helpers."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def half_up(x: Column, digits: int) -> Column:
    """Round half away from zero; binary noise past 10 digits does not decide a tie."""
    return F.round(F.round(x, 10), digits)


def nonzero(x: Column) -> Column:
    """NULL in place of 0, for denominators."""
    return F.nullif(x, F.lit(0.0))


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(hi, x))


def rolling(fn, x: Column, w: WindowSpec, rows: int) -> Column:
    """``fn`` over the last ``rows`` rows, NULL unless all of them hold a value."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(x).over(frame) == rows, fn(x).over(frame))
