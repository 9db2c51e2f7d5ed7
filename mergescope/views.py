"""The provided tables read as the domain's: pulls, reviews, files, source texts, findings and so on.

Everything is computed in the row itself, so each view is a scan with a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import prepare, spread

EXTENSIONS = ["py", "java", "js", "ts", "go", "php", "cpp", "rb", "c", "txt"]
STATES = {"A": "APPROVED", "N": "COMMENTED", "R": "CHANGES_REQUESTED"}
FINDING_TYPES = {
    "error": "error", "view": "warning", "click": "refactor", "purchase": "convention", "signup": "information",
}
# Prose becomes code-like text: each replacement puts a construct the features look for.
CODE_REPLACEMENTS = [
    (" the ", "\ndef the("), (" and ", "\n# and "), (" is ", " fix error "), (" of ", " // add new "),
    (" der ", "\nfunction der("), (" le ", "\nprint("), (" to ", "\nimport os "), (" la ", " improve security "),
    (" in ", " if return "), (" that ", "\nint that("),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def _choice(options: list[str], key: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), F.pmod(key, F.lit(len(options))).cast("int"))


def _mapped(mapping: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), key)


def pulls(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    merged = F.col("o_orderstatus") == "F"
    created = F.col("o_orderdate").cast("timestamp")
    price = F.floor("o_totalprice")
    return o.select(
        F.col("o_orderkey").alias("pr_id"),
        F.col("o_custkey").alias("author"),
        F.col("o_orderpriority").alias("repository_name"),
        F.concat(F.col("o_orderpriority"), F.lit(" #"), F.col("o_orderkey").cast("string")).alias("title"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("Change "), price.cast("string"))).alias("body"),
        created.alias("created_at"),
        F.when(merged, F.timestamp_seconds(F.unix_seconds(created) + price)).alias("merged_at"),
        merged.alias("merged"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("state"),
        (price % 20).cast("long").alias("commits"),
        (F.col("o_custkey") % 5).alias("comments"),
        (F.col("o_orderkey") % 4).alias("review_comments"),
    )


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("pr_id"),
        F.col("l_suppkey").alias("reviewer"),
        F.when(F.col("l_tax") > 0, F.col("l_shipdate").cast("timestamp")).alias("submitted_at"),
        _mapped(STATES, F.col("l_returnflag")).alias("state"),
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("pr_id"),
        F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).alias("position"),
        F.col("l_partkey").alias("file_id"),
        F.col("l_quantity").cast("long").alias("additions"),
        F.round(F.col("l_tax") * 100).cast("long").alias("deletions"),
    )


def authors(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    # 788918400 is the start of 1995 in seconds; authors joined up to five years earlier.
    return c.select(
        F.col("c_custkey").alias("author"),
        F.floor("c_acctbal").cast("long").alias("contributions"),
        F.timestamp_seconds(F.lit(788918400) - (F.col("c_custkey") % 1825) * 86400 - F.col("c_custkey") % 7 * 3600).alias("joined_at"),
    )


def commits(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderpriority").alias("repository_name"), F.col("o_custkey").alias("author"), F.col("o_orderkey").alias("commit_id"))


def pull_labels(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("pr_id"),
                    F.when(F.col("event_type") == "error", "bug").otherwise(F.col("event_type")).alias("name"))


def comments(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("pr_id"), F.col("turn").alias("position"), F.col("text").alias("body"))


def code_text(column: Column) -> Column:
    for old, new in CODE_REPLACEMENTS:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")
    ext = _choice(EXTENSIONS, F.col("doc_id"))
    return d.select(
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("repository"),
        ext.alias("ext"),
        F.concat(F.col("source"), F.lit("/file_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"),
        code_text(F.col("text")).alias("content"),
    )


def findings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        "event_id", F.col("user_id").alias("file_id"), _mapped(FINDING_TYPES, F.col("event_type")).alias("type"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def function_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row per function of a file."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_partkey").alias("file_id"), F.col("l_quantity").alias("nloc"),
                     (F.col("l_linenumber") * 3).alias("ccn"), F.floor(F.col("l_extendedprice") / 100).alias("tokens"))


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the benchmark passages with a polarity in [-1, 1] in steps of 1/4 from their length."""
    words = table(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", ((F.length("word") % 9 - 4) / F.lit(4.0)).alias("polarity"))


def pull_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Nested pull-request documents, one per source text."""
    d = spread(table(spark, sf, "documents"), "doc_id")
    n = F.col("n_chars")
    every = F.sequence(F.lit(1), (n % 4 + 1).cast("int"))
    return d.select(
        F.col("doc_id").alias("number"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("body"),
        (n % 7).alias("changed_files"), (n % 101).alias("additions"), (n % 53).alias("deletions"), (n % 6).alias("commits"),
        (n % 5).alias("comments"), (n % 3).alias("review_comments"),
        F.when(F.col("doc_id") % 2 == 0, n / F.lit(8.0)).alias("time_to_merge"),
        (F.col("doc_id") % 2 == 0).alias("merged"),
        F.when(n % 3 == 0, F.array(F.lit("bug"), F.col("lang"))).when(n % 3 == 1, F.array(F.col("lang"))).alias("labels"),
        F.transform(every, lambda i: F.struct(F.concat(F.col("source"), F.lit("/file_"), ((F.col("doc_id") + i) % 100).cast("string"), F.lit("."), _choice(EXTENSIONS, (F.col("doc_id") + i) % 100)).alias("filename"))).alias("files"),
        F.when(n % 9 != 0, F.transform(every, lambda i: F.struct(
            F.when((n + i) % 4 != 0, F.concat(F.lit("user"), ((n + i) % 3).cast("string"))).alias("user"),
            F.when((n + i) % 5 != 0, i / F.lit(2.0)).alias("review_time"),
            F.when((n + i) % 2 == 0, "APPROVED").otherwise("COMMENTED").alias("state")))).alias("reviews"),
        F.transform(F.split("text", "\n"), lambda line: F.struct(line.alias("body"))).alias("issue_comments"),
        (n % 40).alias("author_experience"), (n / F.lit(16.0)).alias("author_tenure"), (n % 900).alias("author_contributions"),
        F.col("source").alias("repository_name"),
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Binary predictions with many distinct scores and ties, one per line item."""
    li = table(spark, sf, "lineitem")
    score = (F.floor("l_extendedprice") + F.round(F.col("l_discount") * 100) * 5000) / F.lit(155000.0)
    return li.select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"), score.alias("score"), (score >= 0.5).cast("int").alias("prediction"))


def scored_multi(spark: SparkSession, sf: str, extra: list[Column] | None = None) -> DataFrame:
    """Three-class predictions with one score per class."""
    li = table(spark, sf, "lineitem")
    a, n, r = F.col("l_quantity"), F.col("l_linenumber") * 7.0, F.round(F.col("l_tax") * 100) * 6
    total = a + n + r
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return li.select(
        *(extra or []), y.alias("y"), (a / total).alias("p0"), (n / total).alias("p1"), (r / total).alias("p2"),
        F.when((a >= n) & (a >= r), 0).when(n >= r, 1).otherwise(2).alias("prediction"))


def regressed(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric predictions, one per line item."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("pr_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("file_id"),
        F.col("l_suppkey").alias("reviewer"),
        (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.5 + F.col("l_discount") * 100).alias("prediction"))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their label; a document without one has null."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(l, "doc_id", "left").select("doc_id", "lang", "source", "n_chars", "quality", "toxic")


def pull_paths(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    bare = F.substring_index(F.substring_index(F.col("url"), "#", 1), "?", 1)
    return p.select("page_id", "url", F.regexp_replace(bare, "^https?://", "").alias("path"))


def lint_output(ext: Column, k: Column) -> Column:
    """Raw output of a linter run in the format of the file's language; ``k`` decides how much it found."""
    errors, warnings = k % 4, k % 3
    python = F.concat(F.lit("["), F.array_join(F.concat(
        F.array_repeat(F.lit('{"type": "error"}'), errors), F.array_repeat(F.lit('{"type": "warning"}'), warnings),
        F.array(F.lit('{"type": "refactor"}'))), ", "), F.lit("]"))
    script = F.concat(F.lit('[{"messages": ['), F.array_join(F.concat(
        F.array_repeat(F.lit('{"severity": 2}'), errors), F.array_repeat(F.lit('{"severity": 1}'), warnings)), ", "), F.lit("]}, {\"messages\": [{\"severity\": 1}]}]"))
    xml = F.concat(F.lit("<results><file>"), F.repeat(F.lit("<error/>"), errors), F.repeat(F.lit("<warning/>"), warnings), F.lit("</file></results>"))
    php = F.concat(F.lit('{"totals": {"errors": '), errors.cast("string"), F.lit(', "warnings": '), warnings.cast("string"), F.lit("}}"))
    return (F.when(ext == "py", python).when(ext.isin("js", "ts"), script).when(ext.isin("java", "cpp"), xml)
            .when(ext == "go", F.repeat(F.lit("issue\n"), errors)).when(ext == "php", php))
