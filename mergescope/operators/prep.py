"""Cleaning, filling, encoding and scaling of feature tables.

A ``fit_*`` function reads the table once, for all columns together, and returns a few numbers per column; the
matching ``transform`` puts them into the plan as literals, so it costs no join and no second pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, task_count
from .ordered import dense_ranks
from .quantiles import exact_quantiles

# Values of a column that are matched without a shuffle, if they are short. Each of the others has less than this part of the rows.
COMMON_VALUES = 1024
COMMON_LENGTH = 16_384


# --- columns -------------------------------------------------------------------------------------
def numeric_columns(df: DataFrame) -> list[str]:
    """Numbers, but no booleans, as in a data frame's float and integer classes."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame, booleans: bool = True) -> list[str]:
    kinds = (T.StringType, T.BooleanType) if booleans else (T.StringType,)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def non_null_counts(df: DataFrame) -> dict[str, int]:
    return df.agg(*[F.count(c).alias(c) for c in df.columns]).first().asDict()


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop the columns that are null in every row."""
    filled = non_null_counts(df)
    return df.drop(*[c for c in df.columns if filled[c] == 0])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna("all")


# --- statistics ----------------------------------------------------------------------------------
def medians(df: DataFrame, columns: list[str], approx: bool = False) -> dict[str, float | None]:
    if approx:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5).alias(c) for c in columns]).first()
        return row.asDict()
    return {c: values[0] for c, values in exact_quantiles(df, columns, [0.5]).items()}


def means(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return df.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()


def modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent value of each column, the smallest one among equals, nulls ignored.

    Values are counted first; then the best (count, value) pair is an ordinary maximum, so nothing is sorted.
    """
    result = {}
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        most = counts.agg(F.max("_n").alias("_most"))
        best = counts.join(F.broadcast(most), counts["_n"] == most["_most"]).agg(F.min(c).alias("v")).first()
        result[c] = best["v"]
    return result


def fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Replace nulls by the given value per column; a column whose value is null stays as it is."""
    known = {c: v for c, v in values.items() if v is not None}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in known.items()})


def fill_zero(df: DataFrame) -> DataFrame:
    return df.fillna(0, numeric_columns(df))


# --- scaling -------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Scale:
    """(x - centre) / width per column."""

    centre: dict[str, float | None]
    width: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (F.col(c) - F.lit(self.centre[c]).cast("double")) / F.lit(float(self.width[c])) for c in self.centre}
        )


def fit_standard(df: DataFrame, columns: list[str]) -> Scale:
    """Mean and population deviation; a constant column is only centred."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    return Scale({c: row[f"m_{c}"] for c in columns}, {c: row[f"s_{c}"] or 1.0 for c in columns})


def fit_deviation(df: DataFrame, columns: list[str]) -> Scale:
    """Sample deviation without centring."""
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    return Scale({c: 0.0 for c in columns}, {c: row[c] or 1.0 for c in columns})


def fit_robust(df: DataFrame, columns: list[str]) -> Scale:
    """Median and interquartile range; a zero range divides by one."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    width = {c: (q[2] - q[0]) if q[0] is not None and q[2] != q[0] else 1.0 for c, q in quartiles.items()}
    return Scale({c: q[1] for c, q in quartiles.items()}, width)


# --- encoding ------------------------------------------------------------------------------------
def as_text(df: DataFrame, column: str, null_text: str | None = "nan") -> Column:
    """A value as the text an encoder sees: booleans capitalised, nulls as ``nan`` (or kept null)."""
    c = F.col(column)
    shown = F.initcap(c.cast("string")) if isinstance(df.schema[column].dataType, T.BooleanType) else c.cast("string")
    return F.coalesce(shown, F.lit(null_text)) if null_text is not None else shown


def ordinal_codes(df: DataFrame, columns: list[str], null_text: str | None = "nan") -> DataFrame:
    """(column, value, n, code): rows with each distinct value of a column, and its rank from 0 among them, sorted.

    Only distinct values are ranked. All columns share one pass and one shuffle.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), as_text(df, c, null_text).alias("value")) for c in columns]))
    counts = df.select(pairs.alias("_p")).select("_p.column", "_p.value").where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    values = materialise(counts, "values", rows=df.count() * len(columns))
    return dense_ranks(values, "value", ["column"], "code")


def apply_codes(df: DataFrame, codes: DataFrame, columns: list[str], null_text: str | None = "nan",
                null_code: int | None = None) -> DataFrame:
    """Replace each column by its code from the code table, which is computed once and tells how many rows a value has.

    The commonest values, a bounded number, are matched in place. So only rows with a rare value are shuffled, dealt by
    their number, and no task gets all rows of a hot value.
    """
    codes = materialise(codes, "codes")
    small = codes.groupBy("column").agg(F.count(F.lit(1)).alias("_values"), F.sum("n").alias("_rows"))
    codes = codes.join(F.broadcast(small), "column").withColumn("_common", (F.length("value") <= COMMON_LENGTH) & (
        (F.col("_values") <= COMMON_VALUES) | (F.col("n") * COMMON_VALUES >= F.col("_rows"))))
    found = codes.groupBy("column").agg(F.coalesce(F.sum(F.when(~F.col("_common"), F.col("n"))), F.lit(0)).alias("rare")).collect()
    rare = {r["column"]: r["rare"] for r in found}
    order, split = df.columns, False
    # Columns of common values alone come first, so that the rows are divided once they are narrow.
    for c in sorted(columns, key=lambda c: rare.get(c, 0)):
        rows = rare.get(c, 0)
        if rows and split:
            df = materialise(df, "coded")
        own = codes.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("code").alias("_code"), "_common")
        # The text takes the place of the value, so that it is moved once.
        named = df.withColumn(c, as_text(df, c, null_text))
        near = named.join(F.broadcast(own.where("_common").drop("_common")), F.col(c) == F.col("_v"), "left").drop("_v")
        parts = [near]
        if rows:
            split = True
            rest = near.where(F.col("_code").isNull() & F.col(c).isNotNull()).drop("_code")
            tasks = task_count(df.sparkSession, rows)
            rest = rest.repartition(tasks, c) if tasks else rest
            rest = rest.join(own.where(~F.col("_common")).drop("_common"), F.col(c) == F.col("_v"), "left").drop("_v")
            parts = [near.where(F.col("_code").isNotNull() | F.col(c).isNull()), rest]
        code = F.coalesce(F.col("_code"), F.lit(null_code)) if null_code is not None else F.col("_code")
        df = reduce(DataFrame.unionByName, parts).withColumn(c, code.cast("long")).drop("_code")
    return df.select(*order)


def ordinal_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Codes of the sorted distinct values, null being the text ``nan``."""
    return apply_codes(df, ordinal_codes(df, columns), columns)


def category_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Codes of the sorted distinct values; null gives -1."""
    return apply_codes(df, ordinal_codes(df, columns, None), columns, None, -1)


def map_encode(value: Column, mapping: dict[str, int]) -> Column:
    """Code of a fixed mapping; null for anything else."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), value)


# --- feature tests -------------------------------------------------------------------------------
def anova_f(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, f_score): one-way F statistic of each feature over the label's classes, in one grouped pass.

    The pass keeps count, mean and population variance per class, which stay accurate for large values.
    """
    per_class = df.where(F.col(label).isNotNull()).groupBy(label).agg(
        *[F.count(c).alias(f"n_{c}") for c in features],
        *[F.avg(c).alias(f"m_{c}") for c in features],
        *[F.var_pop(c).alias(f"v_{c}") for c in features],
    )
    long = per_class.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").cast("double").alias("n"),
                 F.col(f"m_{c}").alias("m"), F.col(f"v_{c}").alias("v")) for c in features
    ])).alias("s")).select("s.*").where(F.col("n") > 0)
    total = Window.partitionBy("feature")
    grand = F.sum(F.col("n") * F.col("m")).over(total) / F.sum("n").over(total)
    sums = long.withColumn("grand", grand).groupBy("feature").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.count(F.lit(1)).alias("classes"), F.sum("n").alias("rows"),
    )
    score = (F.col("between") / (F.col("classes") - 1)) / (F.col("within") / (F.col("rows") - F.col("classes")))
    return sums.select("feature", F.when((F.col("within") > 0) & (F.col("classes") > 1), score).alias("f_score"))


def chi_square(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, statistic, degrees): Pearson statistic of each categorical feature against the label.

    Works on the contingency counts; empty cells contribute through n*(sum of O^2/(R*C) - 1). Null is a category of
    its own on either side.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in features]))
    cells = df.select(pairs.alias("p"), F.col(label).alias("label")).groupBy("p.feature", "p.value", "label").agg(
        F.count(F.lit(1)).alias("o"))
    # Written, as the counts serve three times and are few beside the rows.
    cells = materialise(cells, "cells")
    # Margins come from aggregates of the counts, so no window gathers a feature's cells in one task.
    rows = cells.groupBy("feature", "value").agg(F.sum("o").alias("r"))
    columns = cells.groupBy("feature", "label").agg(F.sum("o").alias("c"))
    o, r, c = cells.alias("o"), rows.alias("r"), columns.alias("c")
    same = lambda a, b, name: (F.col(f"{a}.feature") == F.col(f"{b}.feature")) & F.col(f"{a}.{name}").eqNullSafe(F.col(f"{b}.{name}"))
    terms = o.join(r, same("o", "r", "value")).join(c, same("o", "c", "label")).select(
        "o.feature", (F.col("o.o") * F.col("o.o") / (F.col("r.r") * F.col("c.c"))).alias("t"), F.col("o.o").alias("o"))
    sums = terms.groupBy("feature").agg(F.sum("t").alias("t"), F.sum("o").alias("n"))
    sizes = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("values")).join(
        columns.groupBy("feature").agg(F.count(F.lit(1)).alias("classes")), "feature")
    return sums.join(sizes, "feature").select(
        "feature", (F.col("n") * (F.col("t") - 1)).alias("statistic"),
        ((F.col("values") - 1) * (F.col("classes") - 1)).alias("degrees"))


def top_features(scores: DataFrame, k: int | None, score: str = "f_score") -> DataFrame:
    """The k best features, ties by name; all of them for ``None``. Constant features come last."""
    ordered = scores.orderBy(F.col(score).desc_nulls_last(), "feature")
    return ordered if k is None else ordered.limit(k)
