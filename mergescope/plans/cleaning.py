"""From merged feature tables to encoded and scaled ones, and the targets built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..operators import prep
from ..operators.quantiles import exact_quantiles
from ..session import materialise

UNUSED_COLUMNS = ["author_contributions", "pr_id", "security_issues"]


def standardise(df: DataFrame, drop: list[str] = UNUSED_COLUMNS) -> DataFrame:
    """Drop unused columns, fill numbers by the median, code categories, standard-scale the numbers."""
    df = materialise(df.drop(*drop), "features")
    numbers, names = prep.numeric_columns(df), prep.categorical_columns(df)
    codes = prep.ordinal_codes(df, names)
    # A median takes several passes and serves columns with nulls only.
    rows, counts = df.count(), prep.non_null_counts(df.select(*numbers))
    filled = prep.fill(df, prep.medians(df, [c for c in numbers if counts[c] < rows]))
    scaled = prep.fit_standard(filled, numbers).transform(filled)
    return prep.apply_codes(scaled, codes, names)


def robust_scale(df: DataFrame, drop: list[str] = ("pr_id",)) -> DataFrame:
    """Drop the id and empty columns, fill by the median, scale by median and interquartile range.

    Filling with the median moves no rank across it, but it can move the quartiles, so they are taken afterwards.
    """
    df = prep.drop_empty_columns(materialise(df.drop(*drop), "features"))
    numbers = prep.numeric_columns(df)
    filled = prep.fill(df, prep.medians(df, numbers))
    return prep.fit_robust(filled, numbers).transform(filled)


def encode_strings(df: DataFrame) -> DataFrame:
    return prep.ordinal_encode(df, prep.categorical_columns(df, booleans=False))


def weighted_score(weights: dict[str, float]) -> Column:
    terms = [F.lit(weight) * F.col(name).cast("double") for name, weight in weights.items()]
    return sum(terms[1:], terms[0])


def classification_score(weights: dict[str, float] | None = None) -> Column:
    return weighted_score(weights or tables.CLASSIFICATION_WEIGHTS)


def regression_score(weights: dict[str, float] | None = None) -> Column:
    return weighted_score(weights or tables.REGRESSION_WEIGHTS)


def binarise_at_median(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """1 from the median up, else 0; null is not at or above it."""
    # Written, as the median takes several passes.
    df = materialise(df, "scored")
    middle = exact_quantiles(df, [column], [0.5])[column][0]
    return df.withColumn(out or column, F.coalesce(F.col(column) >= F.lit(middle), F.lit(False)).cast("int"))
