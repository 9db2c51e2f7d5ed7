"""A training corpus from documents: each stage works on what the one before it kept.

Rows are known by doc_id and text, so rows with a null doc_id, or one that other texts share, are treated like others. Empty
tables stay empty. All stages but the last return the columns they are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergescope.llm import bpe, decontam, near_dup, pii, toxicity
from mergescope.llm.common import setup, spread_scan, table
from mergescope.llm.queries import surrogate_key, toxic_model
from mergescope.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine scores below one half; it is fitted on the labelled rows of the data set."""
    scored = toxicity.score(spread_scan(docs), toxic_model(spark, sf_dir), out="_toxicity")
    return scored.where("_toxicity < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id, null last, then the smallest text hash.

    Rows are known by id and text, so texts that share an id are judged apart. Rows without words all stay.
    """
    kept = near_dup.survivors(near_dup.groups(spread_scan(docs.select("doc_id", "text"))))
    place = [F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id")]
    kept = materialise(kept.select(*place, F.col("row").alias("_row")), "kept")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # The row as one value, so that its columns may have any name.
    named = docs.where(worded).select(F.struct(*docs.columns).alias("_all"), *place, F.xxhash64("text").alias("_row"))
    named = named.join(kept.hint("merge"), ["_none", "_id", "_row"], "left_semi").dropDuplicates(["_none", "_id", "_row"])
    return named.select("_all.*").unionAll(docs.where(~worded))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    hits, _ = decontam.occurrences(docs, table(spark, sf_dir, "benchmark"))
    hits = materialise(hits.select("doc_key", "text_hash").distinct(), "hits")
    return docs.select("*", *decontam.row_key()).join(hits, ["doc_key", "text_hash"], "left_anti").select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and the length brought up to date."""
    masked = pii.mask(docs, surrogate_key(spark)).select(*docs.columns)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document: their number, and digests of the ids and of the decoded bytes."""
    return bpe.encode_digests(spread_scan(docs.select("doc_id", "text")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("encoding", encode),
]

# A learned score and a tokenizer are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(setup(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
