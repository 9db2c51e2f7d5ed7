"""Readers: tables as CSV, pull-request documents as JSON, source trees as files, reports as text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables, text
from ..operators.prep import drop_empty_rows

# Columns of the landed formats.
DOCUMENT_SCHEMA = (
    "number long, title string, body string, changed_files long, additions long, deletions long, commits long,"
    " comments long, review_comments long, time_to_merge double, merged boolean, labels array<string>,"
    " files array<struct<filename:string>>, reviews array<struct<user:string,review_time:double,state:string>>,"
    " issue_comments array<struct<body:string>>, author_experience long, author_tenure double, author_contributions long"
)
METRICS_COLUMNS = [
    "number_of_line_of_code", "average_number_of_lines_of_code", "average_cyclomatic_complexity_number",
    "average_token_count", "function_count", "warning_count", "function_rate", "number_of_line_of_code_rate",
]
# What the parser puts where nothing stands; no text, so that an empty string is not taken for it.
NO_VALUE = "\u0001"
# Column that takes what does not parse.
BROKEN = "_corrupt"
CODE_METRICS_SCHEMA = "issue_id long, label string, complexity map<string,int>, methods array<string>"


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """CSV with a header. A schema saves the pass that infers types.

    Nothing between two commas is null, a quoted empty string is one. Quoted line breaks are part of a value; ``multi_line=False`` lets one large file be split where there are none.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("nullValue", NO_VALUE)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    """Size metrics of files: eight doubles under a header that may begin with a byte-order mark; blank rows go."""
    schema = ", ".join(f"{name} double" for name in METRICS_COLUMNS)
    return drop_empty_rows(spark.read.option("header", True).schema(schema).csv(path))


def read_documents(spark: SparkSession, root: str, multi_line: bool = True) -> DataFrame:
    """Pull-request documents below ``root``; the first folder level names the repository.

    Only ``.json`` files count. Broken documents and objects without a number are left out.
    """
    return sound_documents(document_options(spark.read, multi_line).json(root), root)


def document_options(reader, multi_line: bool = True):
    """Schema and options of landed documents, for a batch or a stream reader."""
    return (reader.schema(f"{DOCUMENT_SCHEMA}, {BROKEN} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)
            .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", multi_line))


def sound_documents(rows: DataFrame, root: str) -> DataFrame:
    """Documents that parsed and have a number, with the repository their folder names."""
    rows = rows.withColumn("repository_name", first_folder(F.input_file_name(), root))
    return rows.where(F.col(BROKEN).isNull() & F.col("number").isNotNull()).drop(BROKEN)


def first_folder(path: Column, root: str, escaped: bool = True) -> Column:
    """First folder name below ``root`` in a file's path; ``escaped`` paths have URL escapes.

    The whole root is matched, so a folder of the same name further up or down does not count.
    """
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))) if escaped else path
    whole = re.sub(r"^[A-Za-z][\w+.-]*:/*", "/", root).rstrip("/") + "/"
    below = F.substring(plain, F.locate(whole, plain) + len(whole), F.length(plain))
    return F.when(F.locate(whole, plain) > 0, F.regexp_extract(below, "^([^/]+)/", 1)).otherwise(F.lit(""))


def read_code_metrics(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(CODE_METRICS_SCHEMA).option("multiLine", multi_line).json(path)


def read_source_tree(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """(path, repository, ext, bytes) of the files below ``root``; the extension filters before any file is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extensions is not None:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    rows = reader.load(root)
    rows = rows.select("path", first_folder(F.col("path"), root, escaped=False).alias("repository"),
                       text.extension(F.col("path")).alias("ext"), F.col("content").alias("bytes"))
    return rows if extensions is None else rows.where(F.col("ext").isin(extensions))


def decode(df: DataFrame, lenient: bool = False) -> DataFrame:
    """Add ``content`` and ``language``: base64 for binary kinds, else UTF-8 text with line ends normalised.

    Bytes that are not UTF-8 give null, or with ``lenient`` the text without them.
    """
    raw, ext = F.col("bytes"), F.lower(F.col("ext"))
    # A replacement character in a lenient read can only come from a broken byte.
    valid = F.is_valid_utf8(raw.cast("string"))
    cleaned = F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))
    decoded = F.when(valid, raw.cast("string")).otherwise(cleaned if lenient else F.lit(None))
    content = F.when(ext.isin(tables.BINARY_EXTENSIONS), F.replace(F.base64(raw), F.lit("\r\n"), F.lit(""))).otherwise(text.normalise_newlines(decoded))
    return df.withColumns({"content": content, "language": text.language_or_unknown(F.col("ext"))})


def parse_size_reports(df: DataFrame, key: str, report: str = "report") -> DataFrame:
    """Eight metrics from a size report: the first line of eight words after a line that starts with ``Total``.

    A report without such a line gives nulls. The rule is one expression over the report's lines.
    """
    lines = F.split(report, "\n")
    with_place = F.transform(lines, lambda line, i: F.struct(i.alias("i"), F.trim(line).alias("line"), F.startswith(line, F.lit("Total")).alias("total")))
    start = F.array_min(F.transform(F.filter(with_place, lambda s: s["total"]), lambda s: s["i"]))
    rows = df.select(key, with_place.alias("_lines"), start.alias("_start"))
    found = F.filter("_lines", lambda s: (s["i"] > F.col("_start")) & ~s["total"] & (F.size(F.split(s["line"], r"\s+")) == 8))
    words = rows.select(key, F.split(F.get(found, F.lit(0))["line"], r"\s+").alias("_words"))
    return words.select(key, *[F.get("_words", F.lit(i)).try_cast("double").alias(m) for i, m in enumerate(tables.METRICS)])


def read_size_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports from text files, one report per file, keyed by file path."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("report"))
    return parse_size_reports(rows, "path")
