"""Code metrics of labelled issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables, text
from ..operators import prep
from ..session import materialise


def issue_code_metrics(issues: DataFrame) -> DataFrame:
    """(issue_id, label, complexity map, methods array) of issues labelled bug, enhancement or feature.

    ``issues`` has issue_id, title, body and the content of the file it concerns. A function's complexity is not
    parsed: the map gives each distinct method name the number of decision words of the whole text.
    """
    labelled = text.with_label(issues, "title", "body", contains=True)
    methods = text.function_names(F.col("content"))
    weight = (F.regexp_count("content", F.lit(r"\b(?:if|for|while|return)\b")) + 1).cast("int")
    named = labelled.select("issue_id", "label", methods.alias("methods"), weight.alias("w"))
    rows = named.select(
        "issue_id", "label",
        F.map_from_arrays(F.array_distinct("methods"), F.transform(F.array_distinct("methods"), lambda m: F.col("w"))).alias("complexity"),
        "methods",
    )
    # A filter on the label would be pushed below it and work the label out again; it goes to the finished rows.
    return materialise(rows, "issues").where(F.col("label").isin(tables.CODE_METRIC_LABELS))


def issue_features(metrics: DataFrame) -> DataFrame:
    """Sum of the complexity map and number of methods, filled by the mean, with the label's code."""
    total = F.aggregate(F.map_values("complexity"), F.lit(0).cast("long"), lambda a, v: a + v)
    rows = metrics.select(
        "issue_id",
        F.coalesce(total, F.lit(0)).cast("double").alias("complexity"),
        F.when(F.col("methods").isNull(), 0).otherwise(F.size("methods")).cast("double").alias("num_methods"),
        prep.map_encode(F.col("label"), tables.LABEL_CODES).alias("label"),
    )
    filled = prep.fill(rows, prep.means(rows, ["complexity", "num_methods"]))
    return filled.dropna(subset=["label"])
