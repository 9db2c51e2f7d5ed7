"""Numbers as categories for the chi-square test: quantile bins, then one contingency pass."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prep import chi_square
from .quantiles import exact_quantiles

BINS = 32


def bin_edges(df: DataFrame, columns: list[str], bins: int = BINS) -> dict[str, list[float]]:
    """Distinct inner quantiles of each column: ``bins`` parts of about equal size, fewer where values repeat.

    The quantiles come from mergeable sketches, made exact by counting passes; only bounds reach the driver.
    """
    found = exact_quantiles(df, columns, [i / bins for i in range(1, bins)])
    return {c: sorted({e for e in edges if e is not None}) for c, edges in found.items()}


def bin_of(value: Column, edges: list[float]) -> Column:
    """How many edges lie below a value; null stays null, a category of its own."""
    above = sum(((value > F.lit(e)).cast("int") for e in edges), F.lit(0))
    return F.when(value.isNotNull(), above)


def binned_chi_square(df: DataFrame, columns: list[str], label: str, bins: int = BINS) -> DataFrame:
    """(feature, statistic, degrees) of numeric columns of any number of distinct values against a label."""
    edges = bin_edges(df, columns, bins)
    rows = df.select(*[bin_of(F.col(c).cast("double"), edges[c]).alias(c) for c in columns], F.col(label).alias("_label"))
    return chi_square(rows, columns, "_label")


def chi_square_tail(statistic: float, degrees: int) -> float:
    """Probability of at least this statistic by chance: the upper incomplete gamma function, by series or fraction."""
    a, x = degrees / 2, statistic / 2
    if degrees <= 0 or x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    # Lentz's evaluation of the continued fraction.
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return scale * h


def select_features(df: DataFrame, columns: list[str], label: str, keep: int, bins: int = BINS) -> list[str]:
    """The ``keep`` columns least likely independent of the label; ties by larger statistic, then by name."""
    rows = binned_chi_square(df, columns, label, bins).collect()
    rank = {r["feature"]: (chi_square_tail(r["statistic"], r["degrees"]), -r["statistic"], r["feature"]) for r in rows}
    return sorted(sorted(rank, key=rank.get)[:keep], key=columns.index)
