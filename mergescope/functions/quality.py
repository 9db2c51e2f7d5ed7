"""Quality rules for source text and the eight-level rating of size metrics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables, text

_CODE_WORDS = r"\b(?:" + "|".join(tables.CODE_WORDS) + r")\b"
_HASH_RULE = r"#[^\n]*" + _CODE_WORDS
# The alternation binds loosely: any // or /* is enough; only */ needs a code word after it.
_SLASH_RULE = r"//|/\*|\*/[^\n]*" + _CODE_WORDS
_SLASH_RULE_STRICT = r"(?://|/\*|\*/)[^\n]*" + _CODE_WORDS


def debug_print_issue(content: Column, language: Column) -> Column:
    """Message of the language's debug-print rule, null when it does not apply."""
    result = F.when(F.lit(False), F.lit(""))
    for name, (mark, message) in tables.DEBUG_PRINTS.items():
        result = result.when((language == name) & F.contains(content, F.lit(mark)), F.lit(message))
    return result


def commented_code_issue(content: Column, language: Column, strict: bool = False) -> Column:
    slash = language.isin(tables.SLASH_COMMENT_LANGUAGES)
    slash_rule = _SLASH_RULE_STRICT if strict else _SLASH_RULE
    hit = F.when(slash, F.rlike(content, F.lit(slash_rule))).otherwise(F.rlike(content, F.lit(_HASH_RULE)))
    return F.when(hit, F.lit(tables.COMMENTED_CODE_MESSAGE))


def marker_comment_issue(content: Column, language: Column) -> Column:
    """Older rule: block-comment marks for brace languages, ``# `` for Ruby, code words for Python."""
    hit = (
        F.when(language == "Python", F.rlike(content, F.lit(r"#[^\n]*\b(?:if|for|while|return|class|def)\b")))
        .when(language == "Ruby", F.contains(content, F.lit("# ")))
        .otherwise(F.contains(content, F.lit("/*")) | F.contains(content, F.lit("*/")))
    )
    return F.when(hit, F.lit(tables.COMMENTED_CODE_MESSAGE))


def line_limit(language: Column) -> Column:
    pairs = [F.lit(item) for pair in tables.LINE_LIMITS.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), language), F.lit(tables.DEFAULT_LINE_LIMIT))


def long_line_count(content: Column, language: Column) -> Column:
    """Lines over the language's limit."""
    return text.long_line_count(text.lines_of(content), line_limit(language))


def long_line_issue(count: Column, language: Column) -> Column:
    head, tail = tables.LONG_LINES_MESSAGE.split("{limit}")
    message = F.concat(count.cast("string"), F.lit(" " + head), line_limit(language).cast("string"), F.lit(tail))
    return F.when(count > 0, message)


def issue_list(*issues: Column) -> Column:
    """The messages that apply, in rule order, or the default message alone."""
    found = F.array_compact(F.array(*issues))
    return F.when(F.size(found) == 0, F.array(F.lit(tables.NO_ISSUES_MESSAGE))).otherwise(found)


def with_issues(df: DataFrame, content: str = "content", language: str = "language", out: str = "issues",
                older: bool = False) -> DataFrame:
    """Add the array of quality messages of a source text."""
    c, lang = F.col(content), F.col(language)
    comment = marker_comment_issue(c, lang) if older else commented_code_issue(c, lang)
    kept = df.columns
    df = df.withColumn("_long", long_line_count(c, lang))
    return df.select(
        *kept, issue_list(debug_print_issue(c, lang), comment, long_line_issue(F.col("_long"), lang)).alias(out)
    )


def rating(use_ccn: bool = False, renamed: bool = False, thresholds: Mapping[str, list[float]] | None = None) -> Column:
    """Rating of the columns named in METRICS: the one whose thresholds most of them stay below, the strictest of
    equals, null if a metric is missing.

    By default the complexity metric does not score (published results were made that way), so at most seven of
    eight count. Written as one SQL expression, which is quicker to build than its two hundred parts.
    """
    thresholds = thresholds or tables.RATING_THRESHOLDS
    scored = [i for i, name in enumerate(tables.METRICS) if use_ccn or name != "avg_ccn"]
    by_strictness = sorted(thresholds, key=lambda name: thresholds[name][0])
    shown = [tables.RENAMED_RATINGS.get(name, name) if renamed else name for name in by_strictness]
    scores = []
    for name in by_strictness:
        limits = [repr(float(limit * (1 + tables.RATING_MARGIN))) for limit in thresholds[name]]
        scores.append(" + ".join(f"int({tables.METRICS[i]} <= {limits[i]}D)" for i in scored))
    # Equal maxima: the first position wins.
    best = f"transform(array(array({', '.join(scores)})), s -> array_position(s, array_max(s)))[0]"
    names = ", ".join(f"'{name}'" for name in shown)
    complete = " AND ".join(f"{name} IS NOT NULL" for name in tables.METRICS)
    return F.expr(f"CASE WHEN {complete} THEN get(array({names}), int({best}) - 1) END")


def size_summary(functions: DataFrame, key: str, nloc: str, ccn: str, tokens: str, max_ccn: int = 15,
                 max_length: int = 1000) -> DataFrame:
    """Eight size metrics per file from one row per function; a function warns above either limit."""
    warns = (F.col(ccn) > max_ccn) | (F.col(nloc) > max_length)
    totals = functions.groupBy(key).agg(
        F.sum(nloc).cast("double").alias("nloc"),
        F.sum(ccn).cast("double").alias("_ccn"),
        F.sum(tokens).cast("double").alias("_tokens"),
        F.count(F.lit(1)).cast("double").alias("fun_cnt"),
        F.count_if(warns).cast("double").alias("warning_cnt"),
        F.coalesce(F.sum(F.when(warns, F.col(nloc))), F.lit(0.0)).cast("double").alias("_warned"),
    )
    return totals.select(
        key,
        "nloc",
        (F.col("nloc") / F.col("fun_cnt")).alias("avg_nloc"),
        (F.col("_ccn") / F.col("fun_cnt")).alias("avg_ccn"),
        (F.col("_tokens") / F.col("fun_cnt")).alias("avg_token"),
        "fun_cnt",
        "warning_cnt",
        (F.col("warning_cnt") / F.col("fun_cnt")).alias("fun_rt"),
        F.when(F.col("nloc") > 0, F.col("_warned") / F.col("nloc")).otherwise(F.lit(0.0)).alias("nloc_rt"),
    )
