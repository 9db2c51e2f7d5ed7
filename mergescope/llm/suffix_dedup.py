"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A window is a run of WINDOW bytes of one document's UTF-8 text. A byte goes when a window that covers it starts at
another place too, in any document or the same. The steps:

1. Every window picks the leftmost smallest hash among its runs of ANCHOR bytes. Equal windows pick equal ones, so the
   suffixes to sort are dealt out by this anchor. Neighbouring windows with one anchor form a passage; only anchors met
   twice go on, and equal passages go on once, with the number of their copies. As most passages end there, they are never
   written: one pass over the texts counts the anchors, another finds the passages again.
2. Anchors are the positions whose suffixes are sorted, forwards and, for what stands before them, backwards. Each task
   sorts its own into runs and sends them front-coded: the common prefix with the string before, and the tail.
3. A loser tree merges an anchor's runs. Every loser keeps the length of its common prefix with the last winner: unequal
   lengths decide a match alone, equal ones let it start behind the known prefix, so no prefix is compared twice. Two
   windows are equal if, around the anchor, they lie in one class of common prefixes forwards and one backwards.

The windows of an anchor with very many different passages are not sorted: Spark counts them by their 128-bit hash, so no
task holds all rows of a passage that stands in different surroundings. Such anchors, at most one for HEAVY passages, are
known to the tasks, which find their windows in the texts where these stand. Null text is empty; rows that repeat
a doc_id, or are copies, count as places of their own. A null doc_id is a document like any other. Empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import arrow, covered, mix, packed, rolling, sliding_min, unpack

WINDOW = 200
ANCHOR = 32
# Different passages of an anchor before its windows are counted, and rows that a task merges together.
HEAVY, CHUNK = 20_000, 50_000
# The low half of a position's value is its place, enough for texts of 4 GiB; the high half is its hash.
_PLACE = np.uint64((1 << 32) - 1)


def passages(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, first windows, numbers of windows and bytes before the anchor of a text's passages."""
    a = np.frombuffer(text, np.uint8)
    if len(a) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    h = mix(rolling(mix(np.arange(1, 257, dtype=np.uint64))[a], ANCHOR))
    # The place in the low bits makes the leftmost of equal hashes the smallest.
    place = np.arange(len(h), dtype=np.uint64) & _PLACE
    at = sliding_min((h & ~_PLACE) | place, WINDOW - ANCHOR + 1)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    before = ((at[starts] - starts.astype(np.uint64)) & _PLACE).astype(np.int64)
    return h[starts + before].view(np.int64), starts, np.diff(np.r_[starts, len(at)]), before


def _key(text: Column) -> list[Column]:
    """(id, row), which are never null: a doc_id, and the hash of a text's hash that also tells a null doc_id from 0."""
    return [F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64(text, F.isnull("doc_id")).alias("row")]


def found_anchors(docs: DataFrame) -> DataFrame:
    """(anchor) per passage."""

    def run(t: pa.Table) -> pa.Table:
        found = [passages((x or "").encode("utf-8", "surrogatepass"))[0] for x in t.column("text").to_pylist()]
        return pa.table([pa.array(np.concatenate(found))], names=["anchor"])

    return arrow(docs.select("text"), run, "anchor long")


def found_passages(docs: DataFrame) -> DataFrame:
    """(id, row, anchor, start, n, before, content) per passage."""

    def run(t: pa.Table) -> pa.Table:
        docs_, rows, anchors, starts, counts, befores, contents = [], [], [], [], [], [], []
        for doc, row, text in zip(t.column("id").to_pylist(), t.column("row").to_pylist(), t.column("text").to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            a, s, n, before = passages(raw)
            docs_ += [doc] * len(a)
            rows += [row] * len(a)
            anchors.append(a)
            starts.append(s)
            counts.append(n)
            befores.append(before)
            view = memoryview(raw)
            contents += [xxhash.xxh3_128_digest(view[x:x + k + WINDOW - 1]) for x, k in zip(s.tolist(), n.tolist())]
        return pa.table([pa.array(docs_, pa.int64()), pa.array(rows, pa.int64()), pa.array(np.concatenate(anchors)),
                         pa.array(np.concatenate(starts), pa.int64()).cast(pa.int32()), pa.array(np.concatenate(counts), pa.int64()).cast(pa.int32()),
                         pa.array(np.concatenate(befores), pa.int64()).cast(pa.int32()), pa.array(contents, pa.binary())],
                        names=["id", "row", "anchor", "start", "n", "before", "content"])

    return arrow(docs.select(*_key(F.xxhash64("text")), "text"), run,
                 "id long, row long, anchor long, start int, n int, before int, content binary")


def prefix_length(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix of two suffixes that agree on the first ``known`` bytes."""
    a, b = x[known:], y[known:]
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return known + size
    different = int.from_bytes(a[:size]) ^ int.from_bytes(b[:size])
    return known + size - (different.bit_length() + 7) // 8


def front_coded(strings: list[bytes]) -> tuple[list[int], list[int], list[bytes]]:
    """A sorted run: the order of the strings, each one's common prefix with the one before it, and its tail."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    common = [0, *[prefix_length(strings[x], strings[y], 0) for x, y in zip(order, order[1:])]]
    return order, common, [strings[i][c:] for i, c in zip(order, common)]


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> list[tuple[int, int, int]]:
    """(run, place in it, common prefix with the one before) of all runs' strings in sorted order, by a loser tree."""
    size = 1
    while size < len(runs):
        size *= 2
    at = [0] * len(runs)
    head: list[bytes | None] = [r[0][0] for r in runs] + [None] * (size - len(runs))
    loser, known = [-1] * size, [0] * size

    def play(run: int, have: int, node: int) -> tuple[int, int, int, int]:
        """Match a run against a node's loser: winner and its prefix, loser and its prefix."""
        other, theirs = loser[node], known[node]
        if head[other] is None or head[run] is not None and have > theirs:
            return run, have, other, theirs
        if head[run] is None or have < theirs:
            return other, theirs, run, have
        x, y = head[run], head[other]
        both = prefix_length(x, y, have)
        if both >= len(x) or both < len(y) and x[both] < y[both]:
            return run, have, other, both
        return other, theirs, run, both

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            return node - size, 0
        loser[node], known[node] = build(2 * node + 1)
        run, have = build(2 * node)
        winner, had, loser[node], known[node] = play(run, have, node)
        return winner, had

    winner, have = build(1)
    out = []
    while head[winner] is not None:
        k = at[winner]
        out.append((winner, k, have))
        at[winner] = k = k + 1
        strings, common = runs[winner]
        head[winner], have = (strings[k], common[k]) if k < len(strings) else (None, 0)
        node, run = (winner + size) // 2, winner
        while node:
            run, have, loser[node], known[node] = play(run, have, node)
            node //= 2
        winner = run
    return out


_RUN = "key long, content binary, offset int, n int, copies long, before int, run long, at_f int, common_f int, tail_f binary, at_b int, common_b int, tail_b binary"


def _runs(wanted: DataFrame) -> DataFrame:
    """Front-coded sorted runs of a batch's passages, by anchor.

    Of a passage the suffix from its anchor on and the reversed prefix up to the anchor are sorted, a run each.
    """

    def run(t: pa.Table) -> pa.Table:
        rows, ahead, back, keys = [], [], [], {}
        for text, wants in zip(unpack(t.column("packed")), t.column("wants").to_pylist()):
            for w in wants:
                part, before = text[w["start"]:w["start"] + w["n"] + WINDOW - 1], w["before"]
                keys.setdefault(w["anchor"], []).append(len(rows))
                rows.append([w["anchor"], w["content"], 0, w["n"], w["copies"], before])
                # A passage that is its anchor's only one has nothing to be compared with.
                ahead.append(b"" if w["alone"] else part[before:])
                back.append(b"" if w["alone"] else part[:before][::-1])
        own = uuid.uuid4().int >> 65
        for members in keys.values():
            places = []
            for strings in (ahead, back):
                order, common, tails = front_coded([strings[i] for i in members])
                place = dict(zip(order, zip(range(len(order)), common, tails)))
                places.append([place[i] for i in range(len(members))])
            for i, f, b in zip(members, *places):
                rows[i] += [own, *f, *b]
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        names = [c.split() for c in _RUN.split(", ")]
        cols = list(zip(*rows)) or [()] * len(names)
        return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, names)], names=[n for n, _ in names])

    return arrow(wanted, run, _RUN)


def _windows(docs: DataFrame, heavy: list[int]) -> DataFrame:
    """The passages of heavy anchors, window by window; of equal ones in a batch one, with the number of its copies."""
    heavy = np.array(heavy, np.int64)

    def run(t: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(3)]
        copies: dict[bytes, int] = {}
        for text in t.column("text").to_pylist():
            raw = (text or "").encode("utf-8", "surrogatepass")
            anchors, starts, counts, _ = passages(raw)
            mine = np.isin(anchors, heavy)
            view = memoryview(raw)
            for s, n in zip(starts[mine].tolist(), counts[mine].tolist()):
                content = xxhash.xxh3_128_digest(view[s:s + n + WINDOW - 1])
                copies[content] = copies.get(content, 0) + 1
                if copies[content] == 1:
                    out[0] += [xxhash.xxh3_128_digest(view[k:k + WINDOW]) for k in range(s, s + n)]
                    out[1] += [content] * n
                    out[2] += range(n)
        kinds = [pa.binary(), pa.binary(), pa.int32()]
        found = [pa.array(c, k) for c, k in zip(out, kinds)] + [pa.array([copies[c] for c in out[1]], pa.int64())]
        return pa.table(found, names=["window", "content", "offset", "copies"])

    return arrow(docs.select("text"), run, "window binary, content binary, offset int, copies long")


def _counted(docs: DataFrame, heavy: list[int]) -> DataFrame:
    """Matches of the passages of heavy anchors, as of _merge."""
    windows = materialise(_windows(docs, heavy), "windows")
    # Written, so that Spark can split the rows of a common window in the join.
    again = materialise(windows.groupBy("window").agg(F.sum("copies").alias("k")).where("k > 1").select("window"), "again")
    # A passage that several batches hold is here several times.
    offsets = windows.join(again, "window").groupBy("content").agg(F.array_sort(F.collect_set("offset")).alias("at"))
    return offsets.select("content", F.flatten(F.transform("at", lambda o: F.array(o, o + 1))).alias("spans"))


def _merged(part: pd.DataFrame, direction: str, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the rows within each key's bounds, and the common prefix with the row before (-1 at a key's first)."""
    order, common = np.arange(len(part)), np.full(len(part), -1)
    run, at = part["run"].tolist(), part[f"at_{direction}"].tolist()
    shared, tail = part[f"common_{direction}"].tolist(), part[f"tail_{direction}"].tolist()
    for s, e in bounds:
        if e - s == 1:
            continue
        rows = sorted(range(s, e), key=lambda i: (run[i], at[i]))
        runs: list[tuple[list[bytes], list[int]]] = []
        names: list[list[int]] = []
        last = None
        for i in rows:
            if run[i] != last:
                runs.append(([], []))
                names.append([])
                last, before = run[i], b""
            before = before[:shared[i]] + tail[i]
            runs[-1][0].append(before)
            runs[-1][1].append(shared[i])
            names[-1].append(i)
        merged = merge_runs(runs)
        order[s:e] = [names[r][k] for r, k, _ in merged]
        common[s:e] = [-1, *[c for _, _, c in merged[1:]]]
    return order, common


def repeated_windows(part: pd.DataFrame) -> np.ndarray:
    """Flat flags of the windows of all rows (sorted by key): whether another row of the key, or a copy, has an equal one.

    A window with its anchor at place o equals another if their reversed prefixes agree on o bytes and their suffixes on
    the rest. Rows that agree so far are neighbours in the merged orders, so both classes come from the common prefixes.
    """
    key, n = part["key"].to_numpy(), part["n"].to_numpy().astype(np.int64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    bounds = list(zip(starts.tolist(), np.r_[starts[1:], len(key)].tolist()))
    ahead, common_f = _merged(part, "f", bounds)
    back, common_b = _merged(part, "b", bounds)
    most = lambda order, common: np.maximum(common, np.r_[common[1:], -1])[np.argsort(order)]
    near_f, near_b = most(ahead, common_f), most(back, common_b)
    before = part["before"].to_numpy().astype(np.int64)
    first = np.r_[0, np.cumsum(n)]
    again = np.repeat(part["copies"].to_numpy() > 1, n)
    rank_f, rank_b = np.argsort(ahead), np.argsort(back)
    alone = np.repeat(np.diff(np.r_[starts, len(key)]) == 1, np.diff(np.r_[starts, len(key)]))
    for o in range(WINDOW - ANCHOR + 1):
        at = before - o
        rows = np.flatnonzero(~alone & (at >= 0) & (at < n) & (near_f >= WINDOW - o) & (near_b >= o))
        if len(rows) < 2:
            continue
        both = np.cumsum(common_f < WINDOW - o)[rank_f[rows]] * (len(key) + 1) + np.cumsum(common_b < o)[rank_b[rows]]
        by = np.argsort(both, kind="stable")
        same = both[by][1:] == both[by][:-1]
        hit = rows[by[np.r_[same, False] | np.r_[False, same]]]
        again[first[hit] + at[hit]] = True
    return again


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge whole keys, CHUNK rows and more at a time."""
    held: list[pd.DataFrame] = []

    def done() -> pd.DataFrame:
        p = pd.concat(held, ignore_index=True)
        again = repeated_windows(p)
        n, offset = p["n"].to_numpy(), p["offset"].to_numpy()
        # Runs of flags, cut at the rows' ends.
        first = np.cumsum(n) - n
        edge = again.copy()
        edge[1:] &= ~again[:-1]
        edge[first] = again[first]
        begin = np.flatnonzero(edge)
        last = again.copy()
        last[:-1] &= ~again[1:]
        ends = first + n - 1
        last[ends] = again[ends]
        end = np.flatnonzero(last) + 1
        row = np.searchsorted(first, begin, side="right") - 1
        pairs = np.stack([begin - first[row] + offset[row], end - first[row] + offset[row]], axis=1).ravel()
        each = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
        spans = np.split(pairs, 2 * each[1:]) if len(row) else []
        return pd.DataFrame({"content": p["content"].to_numpy()[row[each]] if len(row) else [], "spans": spans})

    for batch in batches:
        if not len(batch):
            continue
        key = batch["key"].to_numpy()
        if held and sum(map(len, held)) >= CHUNK:
            new = np.flatnonzero(key != held[-1]["key"].iat[-1])
            if len(new):
                held.append(batch.iloc[:new[0]])
                yield done()
                held, batch = [], batch.iloc[new[0]:]
        held.append(batch)
    if held:
        yield done()


def repeats(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, row, spans): runs of window starts that occur elsewhere, as a flat list of [first, last + 1) bounds.

    ``texts`` are the rows of docs as (id, row, doc_id, packed).
    """
    # Written, so that the join below shuffles both sides itself and a hot anchor's rows can be split.
    twice = materialise(found_anchors(docs).groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "anchors")
    shared = materialise(found_passages(docs).join(twice, "anchor"), "shared")
    each = shared.groupBy("anchor", "content").agg(
        F.count("*").alias("copies"), F.min(F.struct("id", "row", "start", "n", "before")).alias("at"))
    each = materialise(each, "contents")
    width = each.groupBy("anchor").agg((F.count("*") > HEAVY).alias("heavy"), (F.count("*") == 1).alias("alone"))
    width = materialise(width, "widths")
    wants = each.join(width.where("not heavy"), "anchor").select(
        "at.id", "at.row", F.struct("anchor", "content", "copies", "alone", "at.start", "at.n", "at.before").alias("want"))
    wants = wants.groupBy("id", "row").agg(F.collect_list("want").alias("wants"))
    # The same keys as of the groups, so that neither the groups nor the joined texts are shuffled again.
    one = texts.join(wants, ["id", "row"]).dropDuplicates(["id", "row"])
    runs = _runs(one).repartition("key").sortWithinPartitions("key")
    matches = runs.mapInPandas(_merge, "content binary, spans array<int>")
    heavy = [r.anchor for r in width.where("heavy").select("anchor").collect()]
    if heavy:
        matches = matches.unionAll(_counted(docs, heavy))
    hits = shared.select("id", "row", "start", "content").join(matches, "content")
    moved = F.transform("spans", lambda x: x + F.col("start")).alias("spans")
    # Copied rows of one document find the same runs; they are told apart when the text is read again.
    return hits.select("id", "row", moved).groupBy("id", "row").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, spans (removed runs as [start, end) pairs) and kept (bytes left)."""
    # One table for both joins, with the same columns and keys, so that Spark shuffles the texts once and reads them twice.
    texts = packed(docs).select(*_key(F.col("row")), "doc_id", "packed")
    all_ = texts.join(repeats(docs, texts), ["id", "row"], "left").select("doc_id", "packed", "spans")

    def run(t: pa.Table) -> pa.Table:
        n, gone, runs, kept = [], [], [], []
        for text, spans in zip(unpack(t.column("packed")), t.column("spans").to_pylist()):
            size = len(text)
            n.append(size)
            if spans:
                cover = covered([(s, e + WINDOW - 1) for s, e in zip(spans[::2], spans[1::2])], size)
                edge = np.flatnonzero(np.diff(np.r_[False, cover, False])).reshape(-1, 2)
                gone.append(int(cover.sum()))
                runs.append(edge.tolist())
                text = np.frombuffer(text, np.uint8)[~cover].tobytes()
            else:
                gone.append(0)
                runs.append([])
            kept.append(text)
        return pa.table({"doc_id": t.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
                         "spans": pa.array(runs, pa.list_(pa.list_(pa.int32()))), "kept": pa.array(kept, pa.binary())})

    return arrow(all_, run, "doc_id long, n_bytes long, n_removed long, spans array<array<int>>, kept binary")
