"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

Words are runs of bytes other than space and 0x09-0x0D with A-Z lower-cased; a document's set holds its distinct
shingles of five words (fewer words: the whole sequence as one shingle; none: an empty set that links with nothing).
Two documents link when the sets' similarity is at least 0.75.

A signature is SYMBOLS b-bit minima. At similarity 0.75 a quarter of the symbols differ on average; DISTANCE lies more
than four standard deviations above that. The multi-index join finds all pairs of signatures within DISTANCE: by the
pigeonhole principle some chunk of the signature has at most ERRORS differing symbols, so each chunk is indexed under
every way to leave out that many symbols, and two signatures within the distance share one of these keys.

Documents with equal sets are one class. Within a key's bucket, pairs are tried in rounds: first each class with the
bucket's smallest, then each with the nearest signature outside its own component, last every pair within the distance
that is still in different components. So groups of copies cost a few pairs a document and no link between components
is lost. Every pair is confirmed on the whole word sequences before it links.

Classes have numbers of their own, so rows that share a doc_id but not the text are different documents, linked only if
their texts are. A component is called after its smallest doc_id; null ids take part, and a component of null ids alone has
a null id. Null text counts as empty. Repeated rows and ties of texts fall into one class. Other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import arrow, by_group, components, mix, packed, rolling, unpack

SHINGLE = 5
SYMBOLS, DISTANCE, CHUNKS = 64, 31, 16
ERRORS = DISTANCE // CHUNKS
# Rows of a bucket compared at once with as many others, and the shingles that they have in all on average.
BLOCK, WEIGHT = 2048, 4_000_000
_FACTORS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_hashes(text: str | bytes | None) -> np.ndarray:
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    w = raw.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))


def shingle_set(text: str | bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    a = mix(word_hashes(text))
    if len(a) < SHINGLE:
        return mix(rolling(a, len(a)) + np.uint64(len(a))) if len(a) else a
    return np.unique(mix(rolling(a, SHINGLE)))


def signature(s: np.ndarray) -> np.ndarray:
    """SYMBOLS minima under different multiplications of the hashes, cut to 16 bits."""
    low = np.fromiter(((s * f).min() for f in _FACTORS), np.uint64, SYMBOLS)
    return (mix(low) & np.uint64(0xFFFF)).astype("<u2")


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """Rows of keys: each chunk with every choice of ERRORS symbols left out."""
    out, size = [], SYMBOLS // CHUNKS
    wide = sigs.astype(np.uint64)
    for c in range(CHUNKS):
        for kept in combinations(range(c * size, (c + 1) * size), size - ERRORS):
            key = np.full(len(sigs), hash_of(kept), dtype=np.uint64)
            for k in kept:
                key = mix(key * np.uint64(0x100000001B3) + wide[:, k])
            out.append(key)
    return np.stack(out, axis=1).view(np.int64)


def hash_of(kept: tuple[int, ...]) -> int:
    return sum((k + 1) << (8 * i) for i, k in enumerate(kept))


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_shingles, set_hash, sig) per row; ``row`` is the text's hash."""

    def run(t: pa.Table) -> pa.Table:
        n, digests, sigs = [], [], []
        for text in t.column("text").to_pylist():
            s = shingle_set(text)
            n.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            sigs.append(signature(s).tobytes() if len(s) else None)
        return pa.table({"doc_id": t.column("doc_id"), "row": t.column("row"), "n_shingles": pa.array(n, pa.int64()),
                         "set_hash": pa.array(digests, pa.binary()), "sig": pa.array(sigs, pa.binary())})

    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    return arrow(rows, run, "doc_id long, row long, n_shingles long, set_hash binary, sig binary")


def keyed_classes(classes: DataFrame) -> DataFrame:
    """(rep, slot, key): the index entries of each class."""

    def run(t: pa.Table) -> pa.Table:
        keys = chunk_keys(np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, SYMBOLS))
        slots = np.tile(np.arange(keys.shape[1], dtype=np.int32), len(keys))
        reps = np.repeat(t.column("rep").to_numpy(), keys.shape[1])
        return pa.table({"rep": reps, "slot": slots, "key": keys.ravel()})

    return arrow(classes.select("rep", "sig"), run, "rep long, slot int, key long")


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def close_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those with signatures within DISTANCE and set sizes that allow the similarity."""
    half = lambda x: classes.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
    both = pairs.join(half("a"), "a").join(half("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def run(t: pa.Table) -> pa.Table:
        x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), "<u2").reshape(-1, SYMBOLS) for c in ("sig_a", "sig_b"))
        return t.select(["a", "b"]).filter(pa.array((x != y).sum(axis=1) <= DISTANCE))

    return arrow(both.select("a", "b", "sig_a", "sig_b"), run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose whole sets are alike."""
    one = texts.select(F.col("rep").alias("a"), F.col("packed").alias("text_a"))
    two = texts.select(F.col("rep").alias("b"), F.col("packed").alias("text_b"))

    def run(t: pa.Table) -> pa.Table:
        last, kept, keep, plain = None, None, [], zstandard.ZstdDecompressor().decompress
        for b, x, y in zip(t.column("b").to_pylist(), t.column("text_a").to_pylist(), t.column("text_b").to_pylist()):
            if b != last:
                last, kept = b, shingle_set(plain(y))
            keep.append(alike(shingle_set(plain(x)), kept, percent))
        return t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return arrow(pairs.join(one, "a").join(two, "b"), run, "a long, b long")


def _own_pairs(slot: int, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which of the rows are within the distance of x and share this slot's key as the first of all keys."""
    size = SYMBOLS // CHUNKS
    equal = rows == x
    per = size - equal.reshape(len(rows), CHUNKS, size).sum(axis=2)
    near = per.sum(axis=1) <= DISTANCE
    first = (per <= ERRORS).argmax(axis=1)
    chunk, choice = divmod(slot, len(list(combinations(range(size), size - ERRORS))))
    near &= first == chunk
    if near.any():
        choices = np.array([[k in kept for k in range(size)] for kept in combinations(range(size), size - ERRORS)])
        at = equal[near].reshape(-1, CHUNKS, size)[:, chunk]
        near[np.flatnonzero(near)] = (at[:, None, :] >= choices[None]).all(axis=2).argmax(axis=1) == choice
    return near


def _tried(part: pd.DataFrame, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of the left block, the rows it must be compared with."""
    sig = np.frombuffer(b"".join(part["sig"]), "<u2").reshape(-1, SYMBOLS)
    comp, side, slot = part["comp"].to_numpy(), part["block"].to_numpy(), int(part["slot"].iat[0])
    left, right = (side == part["i"].iat[0]), (side == part["j"].iat[0])
    for k in np.flatnonzero(left):
        other = right & (comp != comp[k])
        if same:
            other[:k + 1] = False
        other = np.flatnonzero(other)
        if len(other):
            yield k, other[_own_pairs(slot, sig[k], sig[other])]


def _flag(part: pd.DataFrame) -> pd.DataFrame:
    needed = np.zeros(len(part), bool)
    for k, other in _tried(part, part["i"].iat[0] == part["j"].iat[0]):
        if len(other):
            needed[k] = True
            needed[other] = True
    return part[needed]


def _link(percent: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(t) for t in unpack(part["packed"])]
        rep, comp = part["rep"].to_numpy(), part["comp"].to_numpy().copy()
        out = []
        for k, other in _tried(part, part["i"].iat[0] == part["j"].iat[0]):
            for o in other:
                if comp[o] != comp[k] and alike(sets[k], sets[o], percent):
                    out.append((max(rep[k], rep[o]), min(rep[k], rep[o])))
                    comp[comp == comp[o]] = comp[k]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def groups(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per row of docs: doc_id, row (the text's hash), n_shingles, component, component_id (the smallest linked doc_id).

    ``component`` numbers the components within this result; it is null for rows without words.
    """
    spark = docs.sparkSession
    profile = materialise(profiles(docs), "profiles")
    with_set = profile.where("sig is not null")
    # One row of each class stands for its text; the numbers are drawn once, as the table is written.
    some = F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "row")).alias("some")
    classes = with_set.groupBy("set_hash").agg(some, F.min("doc_id").alias("low"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    classes = materialise(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    keyed = keyed_classes(classes)
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = materialise(keyed.join(buckets, "key"), "members")
    # First round: every class with the smallest of each of its buckets.
    star = members.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    close = materialise(close_pairs(star, classes, percent), "close")
    wanted = close.select(F.col("a").alias("rep")).union(close.select(F.col("b").alias("rep"))).distinct()
    texts = materialise(_texts(docs, classes, wanted), "texts")
    first = materialise(confirmed(close, texts, percent), "links")
    comp = components(spark, first)
    # Second round: buckets that still hold several components, every pair within the distance.
    flagged = materialise(by_group(mixed_blocks(members, classes, comp), ["key", "i", "j"], _flag, BLOCKS), "flagged")
    later = materialise(_texts(docs, classes, flagged.select("rep").distinct()), "texts")
    second = materialise(by_group(flagged.join(later, "rep"), ["key", "i", "j"], _link(percent), "a long, b long"), "links")
    comp = components(spark, first.unionAll(second))
    linked = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("set_hash", "low", F.coalesce("component", "rep").alias("component"))
    linked = materialise(linked, "linked")
    names = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    named = linked.join(names, "component").select("set_hash", "component", "component_id")
    out = with_set.drop("sig").join(named, "set_hash").select("doc_id", "row", "n_shingles", "component", "component_id")
    none = F.lit(None).cast("long").alias("component")
    return out.unionAll(profile.where("sig is null").select("doc_id", "row", "n_shingles", none, F.col("doc_id").alias("component_id")))


def survivors(found: DataFrame) -> DataFrame:
    """(doc_id, row) of one document of each component of ``groups``: the smallest id, null last, then the smallest text hash."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    return found.where("component is not null").groupBy("component").agg(first).select("first.doc_id", "first.row")


BLOCKS = "key long, i int, j int, block int, slot int, rep long, comp long, sig binary"


def mixed_blocks(members: DataFrame, classes: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs (i, j) of blocks of buckets that hold several components, with the rows of both.

    Blocks are bounded in rows and in shingles. Two blocks that are of one component alone are not paired.
    """
    several = members.where("n > 2").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    several = several.withColumn("comp", F.coalesce("component", "rep")).drop("component", "hub", "n")
    mixed = several.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    rows = materialise(several.join(mixed, "key").join(classes.select("rep", "sig", "n"), "rep"), "mixed")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / WEIGHT)).cast("int").alias("parts")
    rows = rows.join(rows.groupBy("key").agg(parts), "key").withColumn("block", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    rows = materialise(rows.select("key", "block", "slot", "rep", "comp", "sig"), "blocks")
    blocks = materialise(rows.groupBy("key", "block").agg(F.min("comp").alias("low"), F.max("comp").alias("high")), "spans")
    left, right = (blocks.select("key", F.col("block").alias(x), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}")) for x in "ij")
    pairs = left.join(right, "key").where("i <= j and not (low_i = high_i and low_j = high_j and low_i = low_j)").select("key", "i", "j")
    sides = pairs.select("*", F.col("i").alias("block")).unionAll(pairs.where("i < j").select("*", F.col("j").alias("block")))
    return rows.join(sides, ["key", "block"]).select("key", "i", "j", "block", "slot", "rep", "comp", "sig")


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, packed): the text of each wanted class. Both sides grow with the corpus, so the plan is the same at any size."""
    whole = packed(docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text"))
    places = classes.join(wanted, "rep").select("rep", "some.doc_id", "some.row")
    return whole.join(places.hint("merge"), ["doc_id", "row"]).groupBy("rep").agg(F.min("packed").alias("packed"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') shingle FROM d, unnest(range(1, greatest(len(w) - 3, 2))) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id a, y.doc_id b, count(*) i FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * i >= 75 * (na.n + nb.n - i)),
reach AS (SELECT doc_id id, doc_id r FROM d UNION SELECT id, b FROM reach JOIN links ON r = a),
c AS (SELECT id, min(r) component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, component_id, d.doc_id = component_id kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON d.doc_id = c.id"""
