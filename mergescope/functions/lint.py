"""Counts from the outputs of linters: JSON, XML and plain text, and from a landed findings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

_FINDINGS = "array<struct<type:string>>"
_MESSAGES = "array<struct<messages:array<struct<severity:int>>>>"
_TOTALS = "struct<totals:struct<errors:long,warnings:long>>"


def type_counts(findings: DataFrame, key: str, names: dict[str, str], type_col: str = "type") -> DataFrame:
    """One count column per finding type; ``names`` maps type to column name."""
    return findings.groupBy(key).agg(
        *[F.count_if(F.col(type_col) == kind).alias(name) for kind, name in names.items()]
    )


def severity_counts(messages: DataFrame, key: str, array_col: str) -> DataFrame:
    """Errors (severity 2) and warnings (severity 1) of nested message lists, counted without exploding them."""
    errors = F.size(F.filter(array_col, lambda m: m["severity"] == 2))
    warnings = F.size(F.filter(array_col, lambda m: m["severity"] == 1))
    return messages.groupBy(key).agg(
        F.sum(errors).alias("num_errors"), F.sum(warnings).alias("num_warnings")
    )


def json_type_counts(output: Column, kind: str) -> Column:
    parsed = F.from_json(output, _FINDINGS)
    return F.coalesce(F.size(F.filter(parsed, lambda f: f["type"] == kind)), F.lit(0))


def json_severity_count(output: Column, severity: int) -> Column:
    parsed = F.from_json(output, _MESSAGES)
    every = F.flatten(F.transform(parsed, lambda r: F.coalesce(r["messages"], F.array().cast("array<struct<severity:int>>"))))
    return F.coalesce(F.size(F.filter(every, lambda m: m["severity"] == severity)), F.lit(0))


def json_total(output: Column, field: str) -> Column:
    return F.coalesce(F.from_json(output, _TOTALS)["totals"][field], F.lit(0).cast("long"))


def xml_element_count(output: Column, element: str) -> Column:
    return F.xpath_int(output, F.lit(f"count(//{element})"))


def text_issue_count(output: Column) -> Column:
    return text.line_count(F.coalesce(output, F.lit("")))


def with_lint_counts(df: DataFrame, ext: str = "ext", output: str = "lint_output") -> DataFrame:
    """Dispatch on the extension: each language's linter writes its own format; other files get nulls."""
    e, o = F.col(ext), F.col(output)
    cpp = ["cpp", "cxx", "cc"]
    xml = F.when(F.startswith(o, F.lit("<")), o)
    errors = (
        F.when(e == "py", json_type_counts(o, "error"))
        .when(e == "java", F.coalesce(xml_element_count(xml, "error"), F.lit(0)))
        .when(e.isin("js", "ts"), json_severity_count(o, 2))
        .when(e == "php", json_total(o, "errors"))
        .when(e.isin(cpp), F.coalesce(xml_element_count(xml, "error"), F.lit(0)))
    )
    warnings = (
        F.when(e == "py", json_type_counts(o, "warning"))
        .when(e == "java", F.coalesce(xml_element_count(xml, "warning"), F.lit(0)))
        .when(e.isin("js", "ts"), json_severity_count(o, 1))
        .when(e == "php", json_total(o, "warnings"))
        .when(e.isin(cpp), F.lit(0))
    )
    return df.withColumns(
        {
            "num_errors": errors.cast("long"),
            "num_warnings": warnings.cast("long"),
            "num_issues": F.when(e == "go", text_issue_count(o)).cast("long"),
        }
    )
