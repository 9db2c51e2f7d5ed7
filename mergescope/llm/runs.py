"""Periodic runs of words by internal pattern matching.

The words of a document become numbers, and prefix doubling sorts its suffixes; each round keeps the ranks of all
substrings of 2^k words, so that two places tell in a few look-ups how far they agree, forwards and backwards. A wavelet
matrix over the suffix array answers range successors: where a block occurs next within a window.

For every dyadic length b = 2^k the words are cut into blocks of b. A run of period q, with ceil((2b - 1) / 3) <= q <=
floor((4b - 2) / 3) and at least 4q words, holds a block that occurs again q words later, whole. So each block asks for its
occurrences at these distances. One or two give their distances as candidate periods. Three or more, as they lie within
one block's length, form a progression whose difference d is the block's own period; then the run's period is the distance
between the ends of the two stretches of period d round the block and round its next occurrence. Each candidate is
extended to both sides and counts if it is long enough; equal stretches keep the smallest period.

Several documents share a sort: their words are numbered apart, so nothing matches across them. Memory grows with the
longest document and the words of a pass (PASS_WORDS), which bounds neither texts nor runs.

Null and empty texts have no words and no runs. Each row gets its result, repeated rows and null doc_ids too. Empty tables
give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow, covered

PASS_WORDS = 400_000
REPEATS = 4
LEAST = 6
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept string"

Words = list[bytes]
Rewrite = Callable[[int | None, Words], Words]


class Suffixes:
    """Sorted suffixes of numbered words, with the ranks of all substrings of 1, 2, 4, ... words.

    ``ranks[k][i]`` is the first place in the order of the suffixes that share their first 2^k words with suffix i.
    """

    def __init__(self, a: np.ndarray, starts: np.ndarray):
        n = self.n = len(a)
        self.first = np.repeat(starts, np.diff(np.append(starts, n))).astype(np.int32)
        order = np.argsort(a, kind="stable")
        new = np.append(True, np.diff(a[order]) != 0)
        rank = np.empty(n, np.int32)
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        self.order, self.ranks, self.counts = order, [rank], [np.bincount(rank, minlength=n).astype(np.int32)]
        length = 1
        while True:
            rank, count = self.ranks[-1], self.counts[-1]
            at = np.flatnonzero(count[rank[self.order]] > 1)
            if not len(at):
                break
            i = self.order[at]
            after = np.where(i + length < n, rank[np.minimum(i + length, n - 1)], -1).astype(np.int64)
            key = rank[i].astype(np.int64) * (n + 1) + after + 1
            by = np.argsort(key, kind="stable")
            i, key = i[by], key[by]
            new = np.append(True, key[1:] != key[:-1])
            self.order[at] = i
            rank = rank.copy()
            rank[i] = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
            self.ranks.append(rank)
            self.counts.append(np.bincount(rank, minlength=n).astype(np.int32))
            length *= 2

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and j on agree, i < j."""
        done = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[k]
            inside = j + done < self.n
            done += (inside & (rank[np.where(inside, i + done, 0)] == rank[np.where(inside, j + done, 0)])).astype(np.int64) << k
        return done

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and j agree, i < j, both of one document."""
        done = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, step = self.ranks[k], 1 << k
            inside = i - done - step >= self.first[i]
            done += (inside & (rank[np.where(inside, i - done - step, 0)] == rank[np.where(inside, j - done - step, 0)])).astype(np.int64) << k
        return done


class Wavelet:
    """Wavelet matrix: counts below a bound and selection by size in a range, for many queries at once."""

    def __init__(self, values: np.ndarray, bound: int):
        self.bits, self.zeros = max(1, int(bound).bit_length()), []
        for bit in range(self.bits - 1, -1, -1):
            low = (values >> bit) & 1 == 0
            self.zeros.append(np.append(0, np.cumsum(low)).astype(np.int32))
            values = np.concatenate([values[low], values[~low]])

    def below(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of [left, right) are smaller than x <= bound."""
        out = np.zeros(len(x), np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            l, r, up = zeros[left], zeros[right], (x >> bit) & 1 == 1
            out += np.where(up, r - l, 0)
            left, right = np.where(up, zeros[-1] + left - l, l), np.where(up, zeros[-1] + right - r, r)
        return out

    def select(self, left: np.ndarray, right: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The nth smallest value of [left, right), from 0: after ``below``, the range successor."""
        out, nth = np.zeros(len(nth), np.int64), nth.copy()
        for zeros in self.zeros:
            l, r = zeros[left], zeros[right]
            up = nth >= r - l
            nth -= np.where(up, r - l, 0)
            out = out * 2 + up
            left, right = np.where(up, zeros[-1] + left - l, l), np.where(up, zeros[-1] + right - r, r)
        return out


def candidates(s: Suffixes, tree: Wavelet, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of 2^k words and the periods that their next occurrences propose."""
    b = 1 << k
    near, far = -(-(2 * b - 1) // 3), (4 * b - 2) // 3
    rank, count = s.ranks[k], s.counts[k]
    p = np.arange(0, s.n, b)
    p = p[(count[rank[p]] > 1) & (p + near < s.n)]
    first = rank[p]
    left, right = place[first], place[first + count[first]]
    skip = tree.below(left, right, p + near)
    found = tree.below(left, right, np.minimum(p + far + 1, s.n)) - skip
    has = found > 0
    p, left, right, skip, found = p[has], left[has], right[has], skip[has], found[has]
    one = tree.select(left, right, skip)
    more = found > 1
    two = np.zeros(len(p), np.int64)
    two[more] = tree.select(left[more], right[more], skip[more] + 1)
    few, pair = found < 3, found == 2
    blocks, periods = [p[few], p[pair]], [one[few] - p[few], two[pair] - p[pair]]
    start, at, d = p[~few], one[~few], two[~few] - one[~few]
    if len(start):
        q = at + s.ahead(at, at + d) - start - s.ahead(start, start + d)
        right_one = (q >= near) & (q <= far) & (start + q < s.n)
        blocks.append(start[right_one])
        periods.append(q[right_one])
    return np.concatenate(blocks), np.concatenate(periods)


def find(documents: list[np.ndarray]) -> list[np.ndarray]:
    """Runs (start, length, period) of each document of numbered words, by start and period."""
    sizes = np.array([len(d) for d in documents], np.int64)
    starts = np.cumsum(sizes) - sizes
    empty = np.zeros((0, 3), np.int64)
    if not sizes.sum():
        return [empty] * len(documents)
    kinds = np.cumsum([0, *(int(d.max()) + 1 if len(d) else 0 for d in documents)])
    s = Suffixes(np.concatenate([d + k for d, k in zip(documents, kinds)]), starts[sizes > 0])
    if len(s.ranks) < 2:
        return [empty] * len(documents)
    # Only suffixes whose first two words come again can answer a block.
    again = s.counts[1][s.ranks[1][s.order]] > 1
    place = np.append(0, np.cumsum(again))
    tree = Wavelet(s.order[again], s.n)
    out = []
    for k in range(1, len(s.ranks)):
        p, q = candidates(s, tree, place, k)
        begin, end = p - s.back(p, p + q), p + q + s.ahead(p, p + q)
        long = end - begin >= np.maximum(LEAST, REPEATS * q)
        out.append(np.stack([begin[long], end[long], q[long]], axis=1))
    rows = np.unique(np.concatenate(out), axis=0)
    rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))] if len(rows) else rows
    rows[:, 1] -= rows[:, 0]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    edges = np.searchsorted(rows[:, 0], np.append(starts, s.n))
    return [rows[e:f] - (b, 0, 0) if f > e else empty for e, f, b in zip(edges[:-1], edges[1:], starts)]


def _passes(texts: list[bytes | None], ids: list[int | None], rewrite: Rewrite | None):
    """Lists of documents' words of at least PASS_WORDS in all, the last one apart."""
    some, total = [], 0
    for text, i in zip(texts, ids):
        words = (text or b"").split()
        some.append(rewrite(i, words) if rewrite else words)
        total += len(words)
        if total >= PASS_WORDS:
            yield some
            some, total = [], 0
    if some:
        yield some


def _numbers(words: Words) -> np.ndarray:
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def collapse(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, n_words, runs, kept): every run of a document, and its words without a run's words after its first period.

    Words are runs of anything but space and tab to carriage return. ``rewrite`` may change a document's words first.
    """

    def run(t: pa.Table) -> pa.Table:
        sizes, found, kept = [], [], []
        for some in _passes(t.column("text").cast(pa.binary()).to_pylist(), t.column("doc_id").to_pylist(), rewrite):
            for words, rows in zip(some, find([_numbers(w) for w in some])):
                sizes.append(len(words))
                found.append(rows)
                if len(rows):
                    gone = covered([(s + q, s + n) for s, n, q in rows.tolist()], len(words))
                    words = [words[i] for i in np.flatnonzero(~gone)]
                kept.append(b" ".join(words))
        rows = np.concatenate([np.zeros((0, 3), np.int64), *found])
        fields = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["start", "length", "period"])
        runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), fields)
        return pa.table({"doc_id": t.column("doc_id"), "n_words": pa.array(sizes, pa.int64()), "runs": runs, "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return arrow(docs.select("doc_id", "text"), run, SCHEMA)
