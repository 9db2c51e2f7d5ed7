"""File feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lint, tables, text
from ..operators.joins import lookup_join


def file_features(files: DataFrame, keywords: dict | None = None, lint_output: str | None = None) -> DataFrame:
    """One row per file: lines, functions, comments, keywords, label and, given raw linter output, its counts.

    ``files`` has path, repository, ext and content.
    """
    c = F.col("content")
    labelled = text.with_label(files, "path", "content", "labels")
    if lint_output:
        labelled = lint.with_lint_counts(labelled, "ext", lint_output)
    found = ["num_errors", "num_warnings", "num_issues"] if lint_output else []
    return labelled.select(
        "path", "repository",
        text.newline_count(c).alias("num_lines"),
        text.function_count(c).alias("num_functions"),
        text.comment_count(c).alias("num_comments"),
        text.substring_keyword_count(c, text.keywords_of(F.col("ext"), keywords)).alias("num_keywords"),
        *found, "labels",
    )


def short_file_features(files: DataFrame) -> DataFrame:
    """The variant with word-based function counts and the dotall comment rule."""
    c = F.col("content")
    return text.with_label(files, "path", "content", "labels").select(
        "path", "repository",
        text.newline_count(c).alias("num_lines"),
        text.function_word_count(c).alias("num_functions"),
        text.comment_count(c, dotall=True).alias("num_comments"),
        text.substring_keyword_count(c, text.keywords_of(F.col("ext"))).alias("num_keywords"),
        "labels",
    )


def line_features(files: DataFrame) -> DataFrame:
    """The line-rule variant with several labels per file; complexity and imports for Python only."""
    c, python, lines = F.col("content"), F.col("ext") == "py", F.col("_lines")
    known = files.where(F.col("ext").isin(tables.SOURCE_EXTENSIONS)).withColumn("_lines", text.lines_of(c))
    return known.select(
        "path", "repository",
        text.line_count(c).alias("num_lines"),
        text.function_line_count(lines).alias("num_functions"),
        text.comment_line_count(lines).alias("num_comments"),
        text.issue_line_count(lines).alias("num_keywords"),
        F.when(python, text.cyclomatic_complexity(c)).alias("cyclomatic_complexity"),
        F.when(python, text.import_count(c)).alias("num_imports"),
        text.multi_label(F.col("path"), c).alias("labels"),
    )


def security_table(files: DataFrame, hits: DataFrame, code_files: DataFrame) -> DataFrame:
    """(repo_name, pr_number, file, language, security_analysis), one row per touched file of a known language."""
    named = code_files.select("file_id", "path", "repository", text.language_of(F.col("path")).alias("language"))
    named = named.where(F.col("language").isNotNull())
    result = F.when(F.col("language").isin(tables.SECURITY_LANGUAGES), F.col("security"))
    described = named.join(hits, "file_id", "left").select("file_id", "path", "repository", "language", result.alias("security_analysis"))
    touched = lookup_join(files.select("pr_id", "file_id"), described, ["file_id"], how="inner")
    return touched.select(F.col("repository").alias("repo_name"), F.col("pr_id").alias("pr_number"),
                          F.col("path").alias("file"), "language", "security_analysis")


def pull_file_features(files: DataFrame, code_files: DataFrame, pulls: DataFrame) -> DataFrame:
    """One row per (pull, file) of a language with keywords: the file's features and the pull's label."""
    c = F.col("content")
    ext = F.lower(text.extension(F.col("path")))
    python = F.col("ext") == "py"
    known = code_files.withColumn("ext", ext).where(F.col("ext").isin(list(tables.LANGUAGE_KEYWORDS)))
    described = known.select(
        "file_id",
        text.split_line_count(c).alias("loc"),
        F.when(python, text.docstring_count(c)).otherwise(text.slash_comment_count(c)).alias("comments"),
        F.when(python, text.python_function_count(c)).otherwise(text.function_word_count_short(c)).alias("functions"),
        text.token_keyword_count(c, text.keywords_of(F.col("ext"))).alias("language_keywords_count"),
    )
    labelled = text.with_label(pulls.select("pr_id", "title", "body"), "title", "body").select("pr_id", "label")
    touched = lookup_join(files.select("pr_id", "position", "file_id"), described, ["file_id"], how="inner")
    return touched.join(labelled, "pr_id").select(
        "pr_id", "position", "loc", "comments", "functions", "language_keywords_count", "label")
