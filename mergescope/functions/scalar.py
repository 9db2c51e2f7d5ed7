"""Small value rules of pull requests: durations, tenure, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def hours_between(start: Column, end: Column) -> Column:
    """Hours from start to end, negative when end comes first, null when either is missing."""
    return (micros(end) - micros(start)) / F.lit(MICROS_PER_HOUR)


def tenure_months(joined: Column, at: Column) -> Column:
    """Whole days (rounded down) in units of thirty days."""
    return F.floor((micros(at) - micros(joined)) / F.lit(MICROS_PER_DAY)) / F.lit(30)


def has_label(labels: Column, name: str = "bug") -> Column:
    """Exact membership; a missing list or null members count as no."""
    return F.coalesce(F.array_contains(labels, name), F.lit(False))


def report_number(text: Column) -> Column:
    return text.try_cast("double")
