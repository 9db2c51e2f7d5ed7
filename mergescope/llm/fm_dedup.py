"""Removal of repeated passages with a compressed FM-index per shard.

A window is a run of WINDOW words of one document; a word goes when a window that covers it also starts in a document
with a smaller doc_id. The steps:

1. Every window picks the smallest hash among its runs of ANCHOR words. Equal windows pick the same one, so windows
   meet if they are sharded by this anchor. Neighbouring windows with one anchor form a segment; only anchors of at
   least two documents go on, and equal segments go on once, with their smallest doc_id.
2. A shard's segments are indexed: the suffix order to the depth of a window, its Burrows-Wheeler transform in a wavelet
   matrix of packed bits, and the smallest doc_id of every interval of equal windows. The segments stream through the
   index from the right: backward search adds word by word, a mismatch falls back to the next shorter match, and each
   position whose matching statistic reaches the window's length reports the smallest doc_id of its interval.
3. Each copy of a segment drops the words under windows whose smallest doc_id is less than its own.

The windows of an anchor with very many different segments around it do not go to a shard: Spark aggregates the smallest
doc_id by the window's 128-bit hash, so no task holds all rows of a passage that stands in different surroundings. Null text has no words; a row with null doc_id neither loses words nor counts as a
source. Rows that repeat a doc_id are each judged against smaller ids only. Words are compared by 64-bit hashes.
Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import arrow, covered, mix, packed, rolling, sliding_min, unpack

WINDOW = 50
ANCHOR = 8
# Windows of a segment, words of an index, and different segments of an anchor before its windows are aggregated.
SEGMENT, SHARD_WORDS, HEAVY = 64, 1 << 20, 2000


def split_words(text: bytes) -> list[bytes]:
    return text.split()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class FMIndex:
    """FM-index of a token sequence, ordered to a fixed depth; wavelet matrix of packed bits with counts per 64 bits."""

    def __init__(self, tokens: np.ndarray, depth: int):
        n = len(tokens)
        self.depth, self.n = depth, n
        rank = tokens.astype(np.int64)
        length = 1
        while length < depth:
            step = min(length, depth - length)
            ahead = np.zeros(n, np.int64)
            ahead[:max(n - step, 0)] = rank[step:] + 1
            rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1]
            length += step
        self.order = np.argsort(rank, kind="stable")
        ordered = rank[self.order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        self.starts = starts
        self.group = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        self.low, self.high = starts, np.r_[starts[1:], n]
        # Words that neighbours in the order share, up to the depth; less than none at both ends.
        shared = np.full(n + 1, depth, np.int8)
        shared[starts] = self._agree(tokens, self.order[starts], self.order[starts - 1])
        shared[0] = shared[n] = -1
        self.shared, self._least = shared, None
        # Intervals of one word less than the depth: what is left of a full match when it goes on.
        wide = np.flatnonzero(shared[:n] < depth - 1)
        self.wide = np.cumsum(shared[:n] < depth - 1) - 1
        self.wide_low, self.wide_high = wide, np.r_[wide[1:], n]
        symbols = tokens[self.order - 1]
        size = int(tokens.max(initial=0)) + 1
        counts = np.bincount(tokens, minlength=size)
        self.before = np.r_[0, np.cumsum(counts)[:-1]]
        self.bits = max(1, int(size - 1).bit_length())
        self.packed, self.counted, self.zeros = [], [], []
        row = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (row >> level) & 1
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.packed.append(words)
            self.counted.append(np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int32))[:-1]].astype(np.int32))
            ones = bit.astype(bool)
            self.zeros.append(n - int(ones.sum()))
            row = np.concatenate([row[~ones], row[ones]])
        self.offset = self._walk(np.arange(size), np.zeros(size, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            block, within = at >> 6, (at & 63).astype(np.uint64)
            below = self.packed[k][block] & ((np.uint64(1) << within) - np.uint64(1))
            ones = self.counted[k][block] + np.bitwise_count(below)
            bit = (symbol >> (self.bits - 1 - k)) & 1
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bound of the interval after one more symbol to the left."""
        return self.before[symbol] + self._walk(symbol, at) - self.offset[symbol]

    def _agree(self, tokens: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """How many words two suffixes share, up to the depth."""
        out, still = np.zeros(len(one), np.int8), np.arange(len(one))
        for k in range(self.depth):
            x, y = one[still] + k, two[still] + k
            inside = (x < self.n) & (y < self.n)
            still, x, y = still[inside], x[inside], y[inside]
            same = tokens[x] == tokens[y]
            still = still[same]
            if not len(still):
                break
            out[still] = k + 1
        return out

    def widen(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals round [low, high) of all suffixes that share ``length`` words with them."""
        if self._least is None:
            # Minima of 1, 2, 4, ... neighbours; only a mismatch needs them.
            self._least = [self.shared]
            while 2 ** len(self._least) <= self.n + 1:
                last, half = self._least[-1], 2 ** (len(self._least) - 1)
                self._least.append(np.minimum(last[:-half], last[half:]))
        low, high = low.copy(), high.copy()
        for k in range(len(self._least) - 1, -1, -1):
            least, size = self._least[k], 2 ** k
            down = low - size + 1
            low = np.where((down >= 0) & (least[np.maximum(down, 0)] >= length), low - size, low)
            up = high < len(least)
            high = np.where(up & (least[np.where(up, high, 0)] >= length), high + size, high)
        return low, high

    def match(self, tokens: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Stream passages tokens[end - length:end] through the index, all at once and each from its right end.

        The matching statistic of a place is the longest run of words from there that the index holds, up to the depth.
        Backward search adds a word on the left; where no such match goes on, it gives up words on the right, by the next
        wider interval, until one does. Yields (passage, start within it, group) where the statistic reaches the depth.
        """
        who = np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        statistic = np.zeros(len(ends), np.int64)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            going = lengths[who] >= step
            who, low, high, statistic = who[going], low[going], high[going], statistic[going]
            symbol = tokens[ends[who] - step]
            full = statistic == self.depth
            if full.any():
                # The order says nothing beyond the depth, so a full match gives up its last word before it goes on.
                wide = self.wide[low[full]]
                low[full], high[full], statistic[full] = self.wide_low[wide], self.wide_high[wide], self.depth - 1
            foreign = symbol >= len(self.before)
            low[foreign], high[foreign], statistic[foreign] = 0, self.n, 0
            left = np.flatnonzero(~foreign)
            while len(left):
                a, b = self.extend(symbol[left], low[left]), self.extend(symbol[left], high[left])
                met = a < b
                at = left[met]
                low[at], high[at] = a[met], b[met]
                statistic[at] += 1
                left = left[~met]
                left = left[statistic[left] > 0]
                if len(left):
                    less = np.maximum(np.maximum(self.shared[low[left]], self.shared[high[left]]), 0)
                    low[left], high[left] = self.widen(low[left], high[left], less)
                    statistic[left] = less
            full = statistic == self.depth
            if full.any():
                yield who[full], lengths[who[full]] - step, self.group[low[full]]


def segments(docs: DataFrame) -> DataFrame:
    """(doc_id, row, anchor, start, n, content) per segment: its first window, windows and content hash."""

    def run(t: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in range(6)]
        for doc, row, text in zip(t.column("doc_id").to_pylist(), t.column("row").to_pylist(), t.column("text").to_pylist()):
            a = mix(hash_words(split_words((text or "").encode("utf-8", "surrogatepass"))))
            if len(a) < WINDOW:
                continue
            low = sliding_min(mix(rolling(a, ANCHOR)), WINDOW - ANCHOR + 1)
            starts = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
            ends = np.r_[starts[1:], len(low)]
            if (ends - starts).max() > SEGMENT:
                starts = np.unique(np.concatenate([np.arange(s, e, SEGMENT) for s, e in zip(starts, ends)]))
                ends = np.r_[starts[1:], len(low)]
            raw = memoryview(a.tobytes())
            cols[0] += [doc] * len(starts)
            cols[1] += [row] * len(starts)
            cols[2].append(low[starts].view(np.int64))
            cols[3].append(starts)
            cols[4].append(ends - starts)
            cols[5] += [xxhash.xxh3_128_digest(raw[8 * s:8 * (e + WINDOW - 1)]) for s, e in zip(starts.tolist(), ends.tolist())]
        joined = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in cols[2:5]]
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "row": pa.array(cols[1], pa.int64()), "anchor": joined[0],
                         "start": pa.array(joined[1], pa.int32()), "n": pa.array(joined[2], pa.int32()), "content": pa.array(cols[5], pa.binary())})

    return arrow(docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("row"), "text"), run,
                 "doc_id long, row long, anchor long, start int, n int, content binary")


def _contents(wanted: DataFrame) -> DataFrame:
    """Texts of the wanted segments of each document, but for those of heavy anchors."""

    def run(t: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(5)]
        for text, wants in zip(unpack(t.column("packed")), t.column("wants").to_pylist()):
            words = split_words(text)
            for w in wants:
                if w["heavy"]:
                    continue
                s, n = w["start"], w["n"]
                for c, v in zip(out, (w["anchor"], w["content"], n, w["first"], b" ".join(words[s:s + n + WINDOW - 1]))):
                    c.append(v)
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=["key", "content", "n", "first", "words"])

    return arrow(wanted, run, "key long, content binary, n int, first long, words binary")


def _windows(wanted: DataFrame) -> DataFrame:
    """The wanted segments of heavy anchors, window by window."""

    def run(t: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(4)]
        for text, wants in zip(unpack(t.column("packed")), t.column("wants").to_pylist()):
            if not any(w["heavy"] for w in wants):
                continue
            raw = memoryview(mix(hash_words(split_words(text))).tobytes())
            for w in wants:
                if w["heavy"]:
                    out[0] += [xxhash.xxh3_128_digest(raw[8 * k:8 * (k + WINDOW)]) for k in range(w["start"], w["start"] + w["n"])]
                    out[1] += [w["content"]] * w["n"]
                    out[2] += range(w["n"])
                    out[3] += [w["first"]] * w["n"]
        kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=["window", "content", "offset", "first"])

    return arrow(wanted, run, "window binary, content binary, offset int, first long")


def _aggregated(wanted: DataFrame) -> DataFrame:
    """Matches of the segments of heavy anchors, as of _search."""
    windows = materialise(_windows(wanted), "windows")
    # Written, so that Spark can split the rows of a common window in the join.
    least = materialise(windows.groupBy("window").agg(F.min("first").alias("least")), "least")
    return windows.join(least, "window").select("content", "offset", F.array("least").alias("firsts"), "least")


def shard_matches(words: list[bytes], firsts: np.ndarray) -> list[np.ndarray]:
    """For each passage of a shard, the smallest first id over all occurrences of each of its windows."""
    parts = [w.split(b" ") for w in words]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    hashes = hash_words([w for p in parts for w in p])
    ids = np.unique(hashes, return_inverse=True)[1] + 1
    # One separator, symbol 0, after each passage.
    tokens = np.zeros(len(ids) + len(parts), np.int64)
    tokens[np.arange(len(ids)) + np.repeat(np.arange(len(parts)), lengths)] = ids
    ends = np.cumsum(lengths + 1) - 1
    index = FMIndex(tokens, WINDOW)
    owner = np.repeat(firsts, lengths + 1)
    least = np.minimum.reduceat(owner[index.order], index.starts)
    flat_at = np.r_[0, np.cumsum(lengths - WINDOW + 1)]
    flat = np.full(int(flat_at[-1]), np.iinfo(np.int64).max)
    for who, start, group in index.match(tokens, ends, lengths):
        flat[flat_at[who] + start] = least[group]
    return np.split(flat, flat_at[1:-1])


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Index whole keys together up to SHARD_WORDS words and stream the shard's passages through the index."""
    held: list[pd.DataFrame] = []
    size = 0

    def done(parts: list[pd.DataFrame]) -> pd.DataFrame:
        p = pd.concat(parts)
        found = shard_matches(p["words"].tolist(), p["first"].to_numpy())
        return pd.DataFrame({"content": p["content"].to_numpy(), "offset": np.zeros(len(p), np.int32), "firsts": found,
                             "least": [int(f.min()) for f in found]})

    for batch in batches:
        if not len(batch):
            continue
        counts = (batch["n"] + WINDOW - 1).to_numpy()
        key = batch["key"].to_numpy()
        new_key = np.r_[not held or held[-1]["key"].iat[-1] != key[0], key[1:] != key[:-1]]
        from_ = 0
        for k in np.flatnonzero(new_key):
            if size + counts[from_:k].sum() >= SHARD_WORDS:
                held.append(batch.iloc[from_:k])
                held = [h for h in held if len(h)]
                if held:
                    yield done(held)
                held, size, from_ = [], 0, k
        held.append(batch.iloc[from_:])
        size += int(counts[from_:].sum())
    held = [h for h in held if len(h)]
    if held:
        yield done(held)


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, row, spans): runs of words to remove, as [start, end) pairs that may overlap."""
    found = materialise(segments(docs), "segments")
    several = found.groupBy("anchor").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("anchor")
    # Written, so that the join below shuffles both sides itself and a hot anchor's rows can be split.
    shared = materialise(found.join(materialise(several, "anchors"), "anchor"), "shared")
    each = shared.groupBy("anchor", "content").agg(
        F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "row", "start", "n")).alias("at"))
    each = materialise(each, "contents")
    heavy = materialise(each.groupBy("anchor").count().where(F.col("count") > HEAVY).select("anchor", F.lit(True).alias("heavy")), "heavy")
    wants = each.join(heavy, "anchor", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False))).select(
        "at.doc_id", "at.row", F.struct("anchor", "content", "first", "heavy", "at.start", "at.n").alias("want"))
    wants = wants.groupBy("doc_id", "row").agg(F.collect_list("want").alias("wants"))
    one = packed(docs).join(wants, ["doc_id", "row"]).dropDuplicates(["doc_id", "row"]).select("packed", "wants")
    some = not heavy.isEmpty()
    one = materialise(one, "wanted") if some else one
    shards = _contents(one).repartition("key").sortWithinPartitions("key")
    matches = shards.mapInPandas(_search, "content binary, offset int, firsts array<long>, least long")
    matches = materialise(matches.unionAll(_aggregated(one)) if some else matches, "matches")
    hits = shared.select("doc_id", "row", "start", "content").join(matches, "content").where("least < doc_id")

    def run(t: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        for doc, row, start, offset, firsts in zip(*(t.column(c).to_pylist() for c in ("doc_id", "row", "start", "offset", "firsts"))):
            less = np.flatnonzero(np.asarray(firsts) < doc) + start + offset
            # Windows whose starts lie no further apart than a window cover one run of words.
            breaks = np.flatnonzero(np.diff(less) > WINDOW) + 1
            out[0].append(doc)
            out[1].append(row)
            out[2].append([[int(p[0]), int(p[-1]) + WINDOW] for p in np.split(less, breaks)])
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.list_(pa.int32())))],
                        names=["doc_id", "row", "spans"])

    spans = arrow(hits.select("doc_id", "row", "start", "offset", "firsts"), run, "doc_id long, row long, spans array<array<int>>")
    return spans.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept (the words left, joined by one space, in UTF-8)."""
    all_ = packed(docs).join(removals(docs), ["doc_id", "row"], "left").select("doc_id", "packed", "spans")

    def run(t: pa.Table) -> pa.Table:
        n, gone, kept = [], [], []
        for text, spans in zip(unpack(t.column("packed")), t.column("spans").to_pylist()):
            w = split_words(text)
            n.append(len(w))
            if spans:
                cover = covered(spans, len(w))
                gone.append(int(cover.sum()))
                w = [x for x, c in zip(w, cover.tolist()) if not c]
            else:
                gone.append(0)
            kept.append(b" ".join(w))
        return pa.table({"doc_id": t.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
                         "kept": pa.array(kept, pa.binary())})

    return arrow(all_, run, "doc_id long, n_words long, n_removed long, kept binary")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
x AS (SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') win FROM d, unnest(range(1, greatest(len(w) - 48, 1))) r(s)),
f AS (SELECT win, min(doc_id) m FROM x GROUP BY win),
c AS (SELECT DISTINCT doc_id, p FROM x JOIN f USING (win), unnest(range(s, s + 50)) r(p) WHERE m < doc_id),
k AS (SELECT u.doc_id, count(c.p) n_removed, string_agg(w[u.p], ' ' ORDER BY u.p) FILTER (c.p IS NULL) kept
    FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) p FROM d) u LEFT JOIN c ON u.doc_id = c.doc_id AND u.p = c.p GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(n_removed, 0)::BIGINT n_removed, sha256(coalesce(kept, '')) kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
