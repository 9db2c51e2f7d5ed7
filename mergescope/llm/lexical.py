"""Ranked lexical search over compressed inverted lists by Block-Max MaxScore.

Building: each task turns its documents into shards of about SHARD_TERMS terms. A shard is one row of its documents (ids and
lengths) and one row a term: postings in blocks of BLOCK, as differences of document numbers and frequencies of one, two or
four bytes each, with the last document of each block and the block's front, the pairs (frequency, length) that no other
posting of the block beats in both. Fronts, unlike maximal scores, hold whatever the corpus grows to, as the score rises
with the frequency and falls with the length; a search takes the corpus' statistics and gets exact maxima from them.

Searching: a term's bound in a shard is its largest block maximum times its weight. Lists are ordered by bound; the longest
start of that order whose bounds together stay below the tenth best score so far is non-essential: no document of these
alone can get in. Windows of documents are scored from the essential lists; a candidate is dropped as soon as its score and
the block maxima of the non-essential lists at its place stay below the tenth best, and only blocks with candidates left are
decompressed. The best of every shard are merged at the end.

Tasks hold one shard, and queries in blocks of about QUERY_BLOCK items, each of which goes to every shard. Shards do not
grow with the corpus, and a shard's rows do not either; a document longer than a shard is a shard of its own.

Null, empty and termless texts are no documents here; rows are documents, also if they repeat an id. Null ids rank behind
others of the same score. Items that agree in id and text are one; items of one id with different texts rank on their own.
Null and termless items have no rows. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import LOWER, lower_ascii

BLOCK = 128
SHARD_TERMS = 4_000_000
WINDOW = 4096
QUERY_BLOCK = 256
K = 10
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX = "shard long, term string, df long, total long, lasts binary, widths binary, sizes binary, fronts binary, payload binary"
# Letters in lower case, digits and bytes beyond ASCII stay; all else separates.
BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


class Shard:
    """Postings of a task's documents until they are packed."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[int] = []
        self.counts: list[int] = []
        self.distinct: list[int] = []
        self.total = 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        count, known = Counter(words), self.vocabulary
        self.terms += [known.setdefault(w, len(known)) for w in count]
        self.counts += count.values()
        self.distinct.append(len(count))
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.total += len(words)

    def pack(self, number: int) -> pa.Table:
        """The shard's rows: its documents (term null: ids, lengths, null marks), then its terms."""
        n = len(self.ids)
        lengths = np.array(self.lengths, np.int64)
        doc = np.repeat(np.arange(n), self.distinct)
        term = np.array(self.terms, np.int64)
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], np.array(self.counts, np.int64)[order]
        df = np.bincount(term, minlength=len(self.vocabulary))
        start = np.cumsum(df) - df
        place = np.arange(len(term)) - start[term]
        head = place % BLOCK == 0
        block = np.cumsum(head) - 1
        opens = np.flatnonzero(head)
        ends = np.append(opens[1:], len(term)) - 1
        blocks = -(-df // BLOCK)
        # The first document of a block is told from the last of the block before, of a term from nothing.
        before = np.where(place == 0, -1, np.append(0, doc[:-1]))
        step = doc - before - 1
        width = [1 + (top > 0xFF) + 2 * (top > 0xFFFF) for top in (np.maximum.reduceat(step, opens), np.maximum.reduceat(tf - 1, opens))]
        count = ends - opens + 1
        size = count * (width[0] + width[1])
        base = np.cumsum(size) - size
        payload = np.zeros(int(size.sum()), np.uint8)
        inside = np.arange(len(term)) - opens[block]
        for values, w, offset in ((step, width[0], 0), (tf - 1, width[1], count * width[0])):
            at = (base + offset)[block] + inside * w[block]
            for byte in range(4):
                put = w[block] > byte
                payload[at[put] + byte] = values[put] >> 8 * byte & 0xFF
        # Fronts: by length, then falling frequency; what beats all frequencies before it in its block stays.
        long = lengths[doc]
        by = np.lexsort((-tf, long, block))
        top = tf[by] + block[by] * (int(tf.max()) + 1)
        best = np.append(True, top[1:] > np.maximum.accumulate(top)[:-1])
        pairs = np.stack([tf[by][best], long[by][best]], axis=1).astype("<i4")
        fronts = np.bincount(block[by][best], minlength=len(opens))

        def cut(data: np.ndarray, per: np.ndarray) -> pa.Array:
            """A binary value a term: the bytes of its blocks."""
            at = np.append(0, np.cumsum(np.add.reduceat(per, np.cumsum(blocks) - blocks))).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(blocks), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])

        none = np.array([i is None for i in self.ids])
        ids = np.array([0 if i is None else i for i in self.ids], "<i8")
        ones = np.ones(len(opens), np.int64)
        columns = {
            "shard": np.full(len(df) + 1, number, np.int64),
            "term": pa.array([None, *(w.decode("utf-8", "replace") for w in self.vocabulary)], pa.string()),
            "df": np.append(n, df), "total": np.append(self.total, np.bincount(term, weights=tf).astype(np.int64)),
        }
        packed = {
            "lasts": (ids.tobytes(), cut(doc[ends].astype("<i4"), 4 * ones)), "widths": (none.tobytes(), cut((width[0] + 16 * width[1]).astype(np.uint8), ones)),
            "sizes": (lengths.astype("<i4").tobytes(), cut(fronts.astype(np.uint8), ones)), "fronts": (b"", cut(pairs, 8 * fronts)), "payload": (b"", cut(payload, size)),
        }
        for name, (first, rest) in packed.items():
            columns[name] = pa.concat_arrays([pa.array([first], pa.binary()), rest])
        return pa.table(columns)


def build(docs: DataFrame) -> DataFrame:
    """The index of (doc_id, text), written to the shared folder."""
    limit = SHARD_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Unique among a job's tasks, and the same when one is run again.
        number = TaskContext.get().partitionId() << 32
        shard = Shard()
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                words = (text or b"").translate(BYTES).split()
                if words:
                    shard.add(i, words)
                if shard.total >= limit:
                    yield from shard.pack(number).to_batches(max_chunksize=20_000)
                    number, shard = number + 1, Shard()
        if shard.total:
            yield from shard.pack(number).to_batches(max_chunksize=20_000)

    return materialise(docs.select("doc_id", "text").mapInArrow(run, INDEX), "index")


class Postings:
    """A term's list in a shard; blocks are decompressed when they are asked for."""

    def __init__(self, row: dict, scale: np.ndarray, stats: tuple[int, int]):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.lasts, self.scale, self.payload, self.df = get("lasts", "<i4"), scale, row["payload"], row["df"]
        widths = get("widths", np.uint8)
        self.step, self.tf = widths & 15, widths >> 4
        n = len(self.lasts)
        self.counts = np.full(n, BLOCK)
        self.counts[-1] = self.df - BLOCK * (n - 1)
        size = self.counts * (self.step + self.tf.astype(np.int64))
        self.at = np.cumsum(size) - size
        tf, length = get("fronts", "<i4").reshape(-1, 2).T.astype(np.int64)
        sizes = get("sizes", np.uint8).astype(np.int64)
        self.maxima = np.maximum.reduceat(impact(tf, norm(length, stats)), np.cumsum(sizes) - sizes)
        self.bound = int(self.maxima.max())
        self.docs, self.impacts, self.done = np.empty(self.df, np.int32), np.empty(self.df, np.int64), np.zeros(n, bool)

    def load(self, blocks: np.ndarray) -> None:
        for b in blocks[~self.done[blocks]].tolist():
            count, step, tf, at = int(self.counts[b]), int(self.step[b]), int(self.tf[b]), int(self.at[b])
            step = np.frombuffer(self.payload, KINDS[step], count, at)
            tf = np.frombuffer(self.payload, KINDS[tf], count, at + step.nbytes).astype(np.int64) + 1
            docs = np.cumsum(step.astype(np.int32) + 1) + (int(self.lasts[b - 1]) if b else -1)
            here = slice(b * BLOCK, b * BLOCK + count)
            self.docs[here], self.impacts[here], self.done[b] = docs, impact(tf, self.scale[docs]), True

    def window(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of [low, high) and their impacts."""
        a, b = np.searchsorted(self.lasts, [low, high - 1])
        last = min(int(b), len(self.lasts) - 1)
        self.load(np.arange(a, last + 1))
        docs = self.docs[a * BLOCK:last * BLOCK + int(self.counts[last])] if a <= last else self.docs[:0]
        x, y = np.searchsorted(docs, [low, high])
        return docs[x:y], self.impacts[a * BLOCK + x:a * BLOCK + y]

    def maximum(self, docs: np.ndarray) -> np.ndarray:
        """The block maxima at documents; 0 behind the last one."""
        return np.append(self.maxima, 0)[np.searchsorted(self.lasts, docs)]

    def find(self, docs: np.ndarray) -> np.ndarray:
        """The impacts of documents, in order; 0 for those without the term."""
        block = np.searchsorted(self.lasts, docs)
        out = np.zeros(len(docs), np.int64)
        for b in np.unique(block[block < len(self.lasts)]).tolist():
            self.load(np.array([b]))
            here = slice(b * BLOCK, b * BLOCK + int(self.counts[b]))
            mine = np.flatnonzero(block == b)
            at = np.searchsorted(self.docs[here], docs[mine])
            met = self.docs[here][at] == docs[mine]
            out[mine[met]] = self.impacts[here][at[met]]
        return out


FOUND = pa.schema([(name, pa.int64()) for name in ("item_id", "item_hash", "doc_id", "score")])
KINDS = {1: np.dtype("u1"), 2: np.dtype("<u2"), 4: np.dtype("<u4")}


def norm(length: np.ndarray, stats: tuple[int, int]) -> np.ndarray:
    """Documents' lengths against the mean, in hundredths."""
    n, total = stats
    return 100 - 90 + 90 * length * n // total


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def best(lists: list[tuple[Postings, int]], n: int, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents of a shard for weighted lists: numbers and scores, ties by rank."""
    lists = sorted(lists, key=lambda x: x[0].bound * x[1])
    upto = np.cumsum([p.bound * w for p, w in lists])
    docs, scores, least = np.empty(0, np.int64), np.empty(0, np.int64), 1
    for low in range(0, n, WINDOW):
        high = min(n, low + WINDOW)
        cut = int(np.searchsorted(upto, least))
        if cut == len(lists):
            break
        total = np.zeros(high - low, np.int64)
        for p, w in lists[cut:]:
            at, x = p.window(low, high)
            total[at - low] += w * x
        found = np.flatnonzero(total)
        total, found = total[found], found + low
        if cut:
            tops = [w * p.maximum(found) for p, w in lists[:cut]]
            rest = np.sum(tops, axis=0)
            for i in range(cut - 1, -1, -1):
                stay = total + rest >= least
                if not stay.all():
                    total, found, rest, tops = total[stay], found[stay], rest[stay], [t[stay] for t in tops[:i + 1]]
                if not len(found):
                    break
                p, w = lists[i]
                rest = rest - tops[i]
                total = total + w * p.find(found)
        enough = total >= least
        docs, scores = np.append(docs, found[enough]), np.append(scores, total[enough])
        first = np.lexsort((rank[docs], -scores))[:k]
        docs, scores = docs[first], scores[first]
        if len(docs) == k:
            least = int(scores[-1])
    return docs, scores


def _search(k: int, stats: tuple[int, int]):
    """Shards' rows, then queries, sorted by shard: the k best documents of each shard for each item."""

    def answers(shard: dict, lists: dict, items: list[dict]) -> Iterator[tuple]:
        for item in items:
            known = []
            for x in item["weights"]:
                entry = lists.get(x["term"])
                if entry is not None and x["w"] > 0:
                    if isinstance(entry, dict):
                        entry = lists[x["term"]] = Postings(entry, shard["scale"], stats)
                    known.append((entry, x["w"]))
            if known:
                for doc, score in zip(*map(np.ndarray.tolist, best(known, len(shard["ids"]), shard["rank"], k))):
                    yield item["item_id"], item["item_hash"], None if shard["none"][doc] else int(shard["ids"][doc]), score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, lists = None, {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != now:
                    now, shard, lists = row["shard"], {}, {}
                if row["kind"]:
                    found = list(answers(shard, lists, row["items"]))
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * 4, FOUND.names)
                elif row["term"] is not None:
                    lists[row["term"]] = row
                else:
                    ids, none = np.frombuffer(row["lasts"], "<i8"), np.frombuffer(row["widths"], bool)
                    rank = np.empty(len(ids), np.int64)
                    rank[np.lexsort((ids, none))] = np.arange(len(ids))
                    scale = norm(np.frombuffer(row["sizes"], "<i4").astype(np.int64), stats)
                    shard = {"ids": ids, "none": none, "rank": rank, "scale": scale}

    return run


def search(index: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of an index for each item (item_id, text)."""
    documents = index.where("term is null")
    n, total, shards = documents.selectExpr("coalesce(sum(df), 0)", "coalesce(sum(total), 0)", "count(*)").first()
    words = F.array_distinct(F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0)))
    items = materialise(items.select("item_id", "text").distinct().select("item_id", F.xxhash64("text").alias("item_hash"), F.explode(words).alias("term")), "items")
    met = materialise(index.join(items.select("term").distinct(), "term", "left_semi"), "lists")
    weight = F.floor(1000 * F.log((2 * F.lit(float(n)) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = met.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.alias("w"))
    queries = items.join(weights, "term").groupBy("item_id", "item_hash").agg(F.collect_list(F.struct("term", "w")).alias("weights"))
    queries = materialise(queries, "queries")
    blocks = -(-queries.count() // QUERY_BLOCK)
    block = F.pmod(F.xxhash64("item_id", "item_hash"), F.lit(max(blocks, 1)))
    packed = queries.groupBy(block.alias("block")).agg(F.collect_list(F.struct("item_id", "item_hash", "weights")).alias("items")).drop("block")
    # A block of queries for every shard: the stated queries against all rows.
    asked = documents.select("shard").crossJoin(packed).select("shard", F.lit(1).alias("kind"), "items")
    rows = documents.unionByName(met).withColumn("kind", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    width = max(1, min(shards, index.sparkSession.sparkContext.defaultParallelism * 1000))
    sorted_rows = rows.repartition(width, "shard").sortWithinPartitions("shard", "kind")
    found = sorted_rows.mapInArrow(_search(k, (int(n), int(total))), "item_id long, item_hash long, doc_id long, score long")
    order = Window.partitionBy("item_id", "item_hash").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, '{LOWER[0]}', '{LOWER[1]}'), '{TERM}') AS ws FROM documents),
d1 AS (SELECT *, len(ws)::BIGINT AS n FROM d WHERE len(ws) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d1),
q AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, '{LOWER[0]}', '{LOWER[1]}'), '{TERM}')) AS term FROM benchmark),
p AS (
  SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ws) AS term FROM d1) WHERE term IN (SELECT term FROM q) GROUP BY rid, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
x AS (
  SELECT item_id, text, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d1 USING (rid), s GROUP BY item_id, text, rid, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= {K}"""
