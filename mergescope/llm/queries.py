"""One registered query per operator, over the whole table it is meant for."""

from __future__ import annotations

import secrets
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog.registry import Entry
from ..session import materialise
from . import ann, bpe, chat, decontam, fm_dedup, lexical, mixing, near_dup, pii, runs, suffix_dedup, toxicity, warc
from .common import spread_scan, table

ENTRIES: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None):
    def add(run):
        ENTRIES[name] = Entry(name, covers, run, sql)
        return run

    return add


@query("op6_byte_bpe", "byte-level BPE encoding and decoding of documents")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_digests(spread_scan(table(spark, sf, "documents").select("doc_id", "text")))


@query("op10_decontamination", "benchmark windows in documents by a prefix-filtered set join", decontam.SQL)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query("op5_minhash_near_dedup", "near-duplicate documents by a multi-index Hamming join of MinHash signatures", near_dup.SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    found = near_dup.groups(spread_scan(table(spark, sf, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op4_fm_substring_dedup", "repeated 50-word passages by FM-index shards", fm_dedup.SQL)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    found = fm_dedup.deduplicate(spread_scan(table(spark, sf, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_suffix_dedup", "repeated 200-byte strings by a merge sort of suffix runs")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    found = suffix_dedup.deduplicate(spread_scan(table(spark, sf, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_warc", "WARC archives with revisit records, written and read back", warc.SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    manifest = warc.write_archives(spread_scan(table(spark, sf, "pages")))
    return warc.read_archives(manifest, strict=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def toxic_model(spark: SparkSession, sf: str) -> toxicity.Model | None:
    """The machine of a data set's labels, without the rows kept for judging it."""
    labels = table(spark, sf, "labels").select("doc_id", "toxic").where(~toxicity.held_out())
    return toxicity.fit(table(spark, sf, "documents"), labels)


@query("op3_toxicity", "toxicity of documents by a subsequence kernel machine")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread_scan(table(spark, sf, "documents").select("doc_id", "text"))
    scored = toxicity.score(docs, toxic_model(spark, sf))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


KEY = "spark.mergescope.surrogates.key"


def surrogate_key(spark: SparkSession) -> str:
    """The secret of surrogates: the session's setting, or else one drawn for this session and kept in it.

    Set it where surrogates must agree between sessions.
    """
    key = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY, key)
    return key


@query("op9_pii_surrogates", "keyed, type-consistent replacements of personal data in documents")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return pii.mask(table(spark, sf, "documents").select("doc_id", "text"), surrogate_key(spark))


@query("op1_ann", "twenty nearest vectors by a hierarchical k-means tree with best-bin-first search")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return ann.search(spread_scan(table(spark, sf, "embeddings")), F.col("vec_id") % 20 == 0)


@query("op8_chat_turns", "roles of transcript lines by a hidden Markov model, rendered as turns")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    conversations = table(spark, sf, "conversations")
    lines = materialise(chat.transcripts(conversations), "transcripts")
    return chat.turns(lines.drop("state"), chat.learn(chat.known(lines)))


@query("op13_mix", "sources mixed to target weights by prefix sums over hash-random order", mixing.SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents")).drop("source")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, periodic from some place on in one of ten documents, by the checksum of its id."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query("op11_runs", "periodic runs of words by internal pattern matching")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    found = runs.collapse(spread_scan(table(spark, sf, "documents").select("doc_id", "text")), planted)
    line = lambda r: F.concat_ws(",", r.start, r.length, r.period)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("back"), (-r.period).alias("minus"))))
    digest = F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256)
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), "best.length",
        (-F.col("best.minus")).alias("period"), F.expr("1000 * best.length div -best.minus").alias("exponent_milli"),
        digest.alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))


@query("op12_lexical_search", "ten best documents of each benchmark item by Block-Max MaxScore", lexical.SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    index = lexical.build(spread_scan(table(spark, sf, "documents").select("doc_id", "text")))
    return lexical.search(index, table(spark, sf, "benchmark"))
