"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Items and documents become sets of positioned shingles of three words. Every window of an item holds all its shingles,
so the rarest one in the corpus is a necessary prefix: only where a document has it can the window occur. The position
of the shingle in window and document fixes the one start that is possible; it must lie inside the document (positional
and length bound). A candidate counts when the document has every shingle of the window at its place; shingles are
compared as words, so this is exact containment. Windows with a shingle that no document has are dropped at once.

Words are lower-cased (A-Z) runs of letters, digits and characters beyond ASCII. An item with fewer words than a window
is one window; null or wordless items have none, and so do items with null item_id. Null text has no words. Repeated
rows of documents each get their result; rows that share a doc_id but not the text are kept apart by the text's hash.
Repeated items with one item_id count once. Empty tables give no rows or no hits. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import lower_ascii, union_all

WINDOW = 10
SHINGLE = 3
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def row_key() -> list[Column]:
    """A key that is never null; the hash also tells a null id from 0."""
    return [F.coalesce("doc_id", F.lit(0)).alias("doc_key"), F.xxhash64("doc_id", "text").alias("text_hash")]


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _shingles(words: str, size: int) -> Column:
    """Array of structs w0, w1, ... of neighbouring words, cut at the end of the list."""
    n = F.size(words)
    lists = [F.slice(words, i + 1, F.greatest(n - size + 1, F.lit(0))).alias(f"w{i}") for i in range(size)]
    return F.arrays_zip(*lists)


def _token(struct: str, size: int) -> Column:
    return F.concat_ws(" ", *[F.col(f"{struct}.w{i}") for i in range(size)])


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, win, length): the words of each window joined by a space."""
    w = items.where("item_id is not null").select("item_id", word_list(F.col("text")).alias("words")).where("size(words) > 0")
    length = F.least(F.size("words"), F.lit(window))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - length + 1))
    w = w.select("item_id", "words", length.alias("length"), starts.alias("at"))
    return w.select("item_id", F.concat_ws(" ", F.slice("words", F.col("at"), F.col("length"))).alias("win"), "length").distinct()


def window_tokens(windows: DataFrame) -> DataFrame:
    """(win, length, size, offset, token) of every distinct window."""
    w = windows.select("win", "length").distinct().withColumn("words", F.split("win", " "))
    parts = []
    for size in range(1, SHINGLE + 1):
        some = w.where(F.least("length", F.lit(SHINGLE)) == size)
        some = some.select("win", "length", F.posexplode(_shingles("words", size)).alias("offset", "s"))
        parts.append(some.select("win", "length", F.lit(size).alias("size"), "offset", _token("s", size).alias("token")))
    return union_all(parts)


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc_key, text_hash, start, length, win) of every window of an item in a document, and the windows of the items."""
    windows = materialise(item_windows(items, window), "item-windows")
    tokens = materialise(window_tokens(windows), "item-tokens")
    wanted = tokens.select("size", "token").distinct()
    sizes = sorted(r.size for r in wanted.select(F.col("size")).distinct().collect())
    d = docs.select(*row_key(), word_list(F.col("text")).alias("words"))
    streams = []
    for size in sizes:
        s = d.select("doc_key", "text_hash", F.size("words").alias("n"), F.posexplode(_shingles("words", size)).alias("pos", "s"))
        s = s.select("doc_key", "text_hash", "n", "pos", _token("s", size).alias("token"))
        streams.append(s.join(wanted.where(F.col("size") == size), "token"))
    if not streams:
        empty = d.select("doc_key", "text_hash", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("win"))
        return empty.where("false"), windows
    found = materialise(union_all(streams).select("doc_key", "text_hash", "n", "pos", "size", "token").distinct(), "shingles")
    rarity = found.groupBy("size", "token").agg(F.count("*").alias("frequency"))
    ranked = tokens.join(rarity, ["size", "token"], "left")
    prefix = ranked.groupBy("win", "length").agg(
        F.count("*").alias("n_tokens"), F.count("frequency").alias("n_met"),
        F.min(F.struct("frequency", "token", "offset", "size")).alias("rarest"))
    prefix = prefix.where("n_met = n_tokens").select("win", "length", "n_tokens", "rarest.token", "rarest.offset", "rarest.size")
    start = F.col("pos") - F.col("offset")
    candidates = found.join(prefix, ["size", "token"]).withColumn("start", start).where("start >= 0 and start + length <= n")
    candidates = candidates.select("doc_key", "text_hash", "start", "win", "length", "n_tokens")
    needed = candidates.join(tokens.select("win", "offset", "size", "token"), "win").withColumn("pos", F.col("start") + F.col("offset"))
    met = needed.join(found.drop("n"), ["doc_key", "text_hash", "pos", "size", "token"])
    checked = met.groupBy("doc_key", "text_hash", "start", "length", "win").agg(F.count("*").alias("n_met"), F.first("n_tokens").alias("n_tokens"))
    return checked.where("n_met = n_tokens").drop("n_met", "n_tokens"), windows


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, items (sorted distinct ids as strings), contaminated."""
    hits, windows = occurrences(docs, items, window)
    hits = materialise(hits, "hits")
    key = ["doc_key", "text_hash"]
    # Length of the union of intervals: what each adds beyond the furthest end before it.
    spans = hits.groupBy(*key, "start").agg(F.max("length").alias("length")).withColumn("end", F.col("start") + F.col("length"))
    before = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = spans.groupBy(*key).agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "reached"), F.lit(0))).alias("n_hit"))
    found = hits.select(*key, "win").distinct().join(windows.select("win", "item_id"), "win").select(*key, "item_id").distinct()
    ids = found.groupBy(*key).agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    hit = covered.join(ids, key)
    d = docs.select("doc_id", *row_key(), F.size(word_list(F.col("text"))).cast("long").alias("n_words"))
    joined = d.join(hit, key, "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(10, len(w)) l, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') win
    FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) r(s) WHERE len(w) > 0),
p AS (SELECT doc_id, l, s, array_to_string(w[s:s + l - 1], ' ') win
    FROM d, (SELECT DISTINCT l FROM i) ls, unnest(range(1, greatest(len(w) - l + 2, 1))) r(s)),
h AS (SELECT DISTINCT doc_id, p.l, s, item_id FROM p JOIN i ON p.win = i.win AND p.l = i.l),
c AS (SELECT doc_id, count(DISTINCT pos) n_hit FROM h, unnest(range(s, s + l)) r(pos) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
    sha256(coalesce(ids, '')) items_sha256, n_hit IS NOT NULL contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""
