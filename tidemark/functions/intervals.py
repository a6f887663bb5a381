"""Interval names and the durations they stand for (fixed values)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Intervals that divide a day, so epoch-aligned buckets are day-aligned.
INTERVALS = {
    "1m": "1 minute",
    "3m": "3 minutes",
    "5m": "5 minutes",
    "15m": "15 minutes",
    "30m": "30 minutes",
    "1h": "1 hour",
    "2h": "2 hours",
    "4h": "4 hours",
    "6h": "6 hours",
    "8h": "8 hours",
    "12h": "12 hours",
    "1d": "1 day",
}
SECONDS = {
    "1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600,
    "2h": 7200, "4h": 14400, "6h": 21600, "8h": 28800, "12h": 43200, "1d": 86400,
}


def floor_to(ts: Column, interval: str) -> Column:
    """Start of the interval holding ``ts``."""
    width = SECONDS[interval] * 1_000_000
    return F.timestamp_micros(F.floor(F.unix_micros(ts) / F.lit(width)) * width)


def ceil_to(ts: Column, interval: str) -> Column:
    """First interval boundary not before ``ts``."""
    width = SECONDS[interval] * 1_000_000
    return F.timestamp_micros(F.ceil(F.unix_micros(ts) / F.lit(width)) * width)


def month_of(ts: Column) -> Column:
    """Partition key ``YYYY-MM`` (UTC session)."""
    return F.date_format(ts, "yyyy-MM")


def since(ts: Column, as_of, days: int) -> Column:
    """Rows of the last ``days`` days before ``as_of``."""
    return ts >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
