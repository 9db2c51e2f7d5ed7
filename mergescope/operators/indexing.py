"""Strings as numbers: a dictionary by falling frequency, kept as a table.

The distinct values of all columns are counted together, sorted over all partitions by count and value, and numbered by
prefix sums of the partitions, so neither driver nor a single task ever holds a dictionary. Encoding joins it back. The
most frequent values, a bounded number, are matched in place; so no value that a shuffle meets is a hot one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .ordered import running_totals

# Values of a column that are matched without a shuffle. Each of the others has less than this part of the rows.
HOT_VALUES = 1024


def fit_dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count, index) of every distinct value: 0 for the most frequent, ties by value. Nulls have none."""
    pair = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    counts = df.select(F.explode(F.array(*pair)).alias("p")).where("p.value is not null").groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("count"))
    numbered = running_totals(counts.withColumns({"_one": F.lit(1), "_down": -F.col("count")}), ["_down", "value"], {"index": "_one"}, ["column"])
    return materialise(numbered.select("column", "value", "count", (F.col("index") - 1).cast("double").alias("index")), "dictionary")


def encode(df: DataFrame, dictionary: DataFrame, columns: list[str], hot_values: int = HOT_VALUES) -> DataFrame:
    """Replace columns by the indices of their values. Null and values that the dictionary lacks get the next number
    after its last."""
    sizes = {r["column"]: r["n"] for r in dictionary.groupBy("column").agg(F.count(F.lit(1)).alias("n")).where(F.col("column").isin(columns)).collect()}
    for c in columns:
        size = sizes.get(c, 0)
        own = dictionary.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("index").alias("_index"))
        named = df.withColumn("_key", F.col(c).cast("string"))
        # A bounded number of rows.
        hot = named.join(F.broadcast(own.where(F.col("_index") < hot_values)), F.col("_key") == F.col("_value"), "left").drop("_value")
        parts = [hot]
        if size > hot_values:
            met = hot.where("_index is not null or _key is null")
            rest = hot.where("_index is null and _key is not null").drop("_index")
            parts = [met, rest.join(own.where(F.col("_index") >= hot_values), F.col("_key") == F.col("_value"), "left").drop("_value")]
        index = F.coalesce("_index", F.lit(float(size)))
        df = reduce(DataFrame.unionByName, parts).select(*[index.alias(x) if x == c else F.col(x) for x in df.columns])
    return df
