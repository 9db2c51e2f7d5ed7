"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

Nearness is the inner product. A coordinate that fills every vector up to the largest norm turns it into Euclidean
nearness for the tree. The tree is fitted on at most SAMPLE distinct vectors (those with the smallest hash of vec_id)
and is so bounded by BRANCHES ** DEPTH leaves; every row is indexed by its way down. A query walks the tree with a
priority queue, always on to the nearest centroid not yet opened, and so orders the leaves. The number of leaves to
visit is widened until CALIBRATION queries, compared with brute force over all rows, reach RECALL.

Rows of a leaf and its queries are dealt out in blocks of bounded size, so a leaf with very many rows has many tasks.
Equal vectors are searched once: of the rows with one vector only the smallest k + 1 ids can be among k nearest, as ties
go to the smaller id. Scores are double sums over the original vectors.

Vectors that are null, zero, hold null or non-finite components or are not of the commonest length take no part. Repeated
rows count once. An empty table, or one without valid queries, gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

SAMPLE, BRANCHES, DEPTH, STEPS = 20_000, 16, 2, 8
CALIBRATION, RECALL = 200, 0.97
# Rows and queries of a task.
ROWS, QUERIES = 8192, 4096


def valid_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Distinct (vec_id, v, key) of the rows that take part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = df.where(F.col(vector).isNotNull() & F.col("vec_id").isNotNull()).where(sound)
    rows = rows.select("vec_id", F.col(vector).cast("array<double>").alias("v"))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (common["n"] if common else 0))
    key = F.concat_ws(":", F.xxhash64("v").cast("string"), F.xxhash64(F.reverse("v")).cast("string"))
    return rows.select("vec_id", "v", key.alias("key")).dropDuplicates(["vec_id", "key"])


class Tree:
    """Centroids of a k-means tree: ``centers[node]``, ``children[node]`` and ``leaf[node]`` (-1 inside)."""

    def __init__(self, sample: np.ndarray, largest: float):
        self.largest = largest
        self.centers: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.branch: list[int] = []
        self.n_leaves = 0
        points = self.lift(sample)
        self._grow(points, points.mean(axis=0), DEPTH, -1, np.random.default_rng(7))

    def lift(self, x: np.ndarray) -> np.ndarray:
        fill = np.sqrt(np.maximum(self.largest ** 2 - (x ** 2).sum(axis=1), 0))
        return np.hstack([x, fill[:, None]])

    def _grow(self, points: np.ndarray, center: np.ndarray, depth: int, branch: int, rng: np.random.Generator) -> int:
        node = len(self.centers)
        self.centers.append(center)
        self.children.append([])
        self.leaf.append(-1)
        self.branch.append(branch)
        if depth == 0 or len(points) < 2 * BRANCHES:
            self.leaf[node] = self.n_leaves
            self.n_leaves += 1
            return node
        centers = points[rng.choice(len(points), BRANCHES, replace=False)]
        for _ in range(STEPS):
            near = self._nearest(points, centers)
            centers = np.stack([points[near == k].mean(axis=0) if (near == k).any() else centers[k] for k in range(BRANCHES)])
        near = self._nearest(points, centers)
        for k in range(BRANCHES):
            below = branch if branch >= 0 else k
            self.children[node].append(self._grow(points[near == k], centers[k], depth - 1, below, rng))
        return node

    @staticmethod
    def _nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
        return ((centers ** 2).sum(axis=1) - 2 * points @ centers.T).argmin(axis=1)

    def descend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf and top branch of each row."""
        points, node = self.lift(x), np.zeros(len(x), np.int64)
        leaf, branch = np.full(len(x), -1), np.full(len(x), 0)
        while True:
            open_ = leaf < 0
            if not open_.any():
                return leaf, branch
            for n in np.unique(node[open_]):
                rows = np.flatnonzero(open_ & (node == n))
                if self.leaf[n] >= 0:
                    leaf[rows], branch[rows] = self.leaf[n], max(self.branch[n], 0)
                else:
                    kids = np.array(self.children[n])
                    node[rows] = kids[self._nearest(points[rows], np.stack([self.centers[k] for k in kids]))]

    def best_bins(self, query: np.ndarray, most: int) -> list[tuple[int, int]]:
        """(leaf, branch) of the leaves to visit, nearest first, by a priority queue over open nodes."""
        q = np.append(query, 0.0)
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append((self.leaf[node], max(self.branch[node], 0)))
                continue
            kids = self.children[node]
            far = ((np.stack([self.centers[k] for k in kids]) - q) ** 2).sum(axis=1)
            for f, k in zip(far.tolist(), kids):
                heapq.heappush(queue, (f, k))
        return out


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64)


def fit(reps: DataFrame, sample: int = SAMPLE) -> Tree | None:
    """Tree on the ``sample`` distinct vectors with the smallest hash of their id."""
    rows = reps.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").toPandas()
    if not len(rows):
        return None
    norm = reps.select(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("n")).first()["n"]
    return Tree(_stack(rows["v"]), float(np.sqrt(norm)))


def indexed(reps: DataFrame, tree: Tree) -> DataFrame:
    """(rep, v, leaf, branch) of every distinct vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                leaf, branch = tree.descend(_stack(b["v"]))
                yield b.assign(leaf=leaf, branch=branch)

    return reps.select("rep", "v").mapInPandas(run, "rep long, v array<double>, leaf int, branch int")


def _best(query: np.ndarray, ids: np.ndarray, v: np.ndarray, seen: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best rows among those seen: (query place, row id, score), with exact sums."""
    near = query @ v.T
    if seen is not None:
        near = np.where(seen, near, -np.inf)
    # All rows up to the k-th best less what the product may be off, so that exact ties are settled by id below.
    nth = min(k, len(v)) - 1
    kth = -np.partition(-near, nth, axis=1)[:, nth]
    margin = 1e-12 * np.sqrt((query ** 2).sum(axis=1) * (v ** 2).sum(axis=1).max())
    who, row = np.nonzero((near >= (kth - margin)[:, None]) & np.isfinite(near))
    score = np.concatenate([(query[who[i:i + 65536]] * v[row[i:i + 65536]]).sum(axis=1) for i in range(0, len(who), 65536)]) if len(who) else np.zeros(0)
    order = np.lexsort((ids[row], -score, who))
    who, row, score = who[order], row[order], score[order]
    first = np.searchsorted(who, who)
    keep = np.arange(len(who)) - first < k
    return who[keep], ids[row[keep]], score[keep]


def calibrated(index: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """Leaves to visit for the wished recall, from the leaves that hold the true neighbours of CALIBRATION queries."""
    some = queries.orderBy(F.xxhash64("query"), "query").limit(CALIBRATION).toPandas()
    if not len(some):
        return 1
    q, names = _stack(some["v"]), some["query"].to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                who, place, score = _best(q, np.arange(len(b)), _stack(b["v"]), None, k)
                yield pd.DataFrame({"query": names[who], "rep": b["rep"].to_numpy()[place], "leaf": b["leaf"].to_numpy()[place], "score": score})

    near = index.mapInPandas(run, "query long, rep long, leaf int, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))
    true = near.withColumn("n", rank).where(F.col("n") <= k).select("query", "leaf").toPandas()
    place = {n: {leaf: i for i, (leaf, _) in enumerate(tree.best_bins(v, tree.n_leaves))} for n, v in zip(names, q)}
    needed = np.sort([place[n][leaf] + 1 for n, leaf in zip(true["query"], true["leaf"])])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def search(rows: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query row, without the row itself."""
    rows = materialise(valid_vectors(rows), "vectors")
    # The k + 1 smallest ids of each vector; more can never be asked for.
    order = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    members = materialise(rows.select("key", "vec_id", "v", order.alias("n")).where(F.col("n") <= k + 1), "members")
    reps = members.where("n = 1").select(F.col("vec_id").alias("rep"), "key", "v")
    asked = rows.where(is_query).select("vec_id", "key")
    tree = fit(reps)
    empty = "query_id long, rank int, vec_id long, score double"
    if tree is None:
        return rows.sparkSession.createDataFrame([], empty)
    index = materialise(indexed(reps, tree), "index")
    classes = asked.select("key").distinct().join(reps, "key").select(F.col("rep").alias("query"), "v")
    classes = materialise(classes, "queries")
    visits = calibrated(index, classes, tree, k, recall)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for query, v in zip(b["query"], b["v"]):
                leaves: dict[int, list[int]] = {}
                for leaf, branch in tree.best_bins(np.asarray(v), visits):
                    leaves.setdefault(branch, []).append(leaf)
                out += [(query, v, branch, found) for branch, found in leaves.items()]
            yield pd.DataFrame(out, columns=["query", "v", "branch", "leaves"])

    routed = classes.mapInPandas(route, "query long, v array<double>, branch int, leaves array<int>")
    # At most one row a branch of the tree, which is bounded.
    blocks = index.groupBy("branch").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks"))
    cuts = F.broadcast(classes.agg(F.greatest(F.ceil(F.count("*") / QUERIES), F.lit(1)).cast("int").alias("cuts")))
    dealt = routed.join(F.broadcast(blocks), "branch").crossJoin(cuts).withColumn("cut", F.pmod(F.xxhash64("query"), "cuts").cast("int"))
    dealt = dealt.select("branch", "cut", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query", "v", "leaves")
    held = index.join(F.broadcast(blocks), "branch").crossJoin(cuts).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    held = held.select("branch", "block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "rep", "v", "leaf")

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            v, ids, leaf = _stack(right["v"]), right["rep"].to_numpy(), right["leaf"].to_numpy()
            for at in range(0, len(left), 512):
                part = left.iloc[at:at + 512]
                open_ = np.zeros((len(part), tree.n_leaves), bool)
                for i, leaves in enumerate(part["leaves"]):
                    open_[i, leaves] = True
                who, found, score = _best(_stack(part["v"]), ids, v, open_[:, leaf], k + 1)
                out.append(pd.DataFrame({"query": part["query"].to_numpy()[who], "rep": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "rep": [], "score": []})

    keys = ["branch", "block", "cut"]
    near = dealt.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(scan, "query long, rep long, score double")
    by_score = lambda ident: F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), ident))
    near = near.withColumn("n", by_score("rep")).where(F.col("n") <= k + 1).drop("n")
    keyed = reps.select("rep", "key")
    spread = near.join(keyed, "rep").join(members.select("key", "vec_id"), "key").select("query", "vec_id", "score")
    spread = spread.withColumn("n", by_score("vec_id")).where(F.col("n") <= k + 1).drop("n")
    asked = asked.join(keyed, "key").select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query"))
    out = asked.join(spread, "query").where("vec_id <> query_id").select("query_id", "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
