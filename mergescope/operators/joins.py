"""Joins to lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a large table to a lookup table with one row per key.

    One equi-join, whatever the sizes: Spark broadcasts the lookup side below its byte threshold, and the adaptive skew
    join that the session sets divides hot keys. Neither side is evaluated twice.
    """
    return left.join(right, on, how)
