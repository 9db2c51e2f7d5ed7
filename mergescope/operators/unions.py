"""Unions of feature tables whose columns drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_tables(frames: list[DataFrame]) -> DataFrame:
    """All rows of all tables by column name; a column a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def preview(df: DataFrame, order: list[str], rows: int = 5) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*order).limit(rows)
