"""Exact nearest neighbours within classes, over a partitioned index whose cells grow with the class.

Building: each class starts as one cell. While cells hold more than a block, each such cell fits a small tree on a bounded
sample of its own rows, in one task: up to 64 leaves, cut at medians of the coordinates that vary most. Its rows walk that
tree in an expression. Every round divides the cells by up to 64, so the rounds grow with the logarithm of the class and
no tree or table of cells ever reaches the driver. A cell is known by its path, and by the least and greatest value of
each coordinate, its box. A cell of equal rows cannot be cut and is dealt out in blocks by hash.

Searching: a row first meets its own cell, which bounds how far its k-th neighbour can be. Pairs of cells are then pruned
from the roots of the trees down: a pair of nodes stays as long as the distance of their boxes is within the largest bound
below the first. Rows go to the cells that are left if the cell's box is within the row's own bound. A task compares at most
a block of rows with a block of others, by one matrix product whose shortlist is measured again exactly. What leaves a task
are ids and distances.

Rows without a vector take no part. Ties go to the smaller id. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .hashing import hash_code, hash_fraction

BLOCK_ROWS = 2048
LEAF_BITS = 6
# Rows of a cell that its tree is fitted on.
SAMPLE_ROWS = 4096
# Distances are rounded to this many places before ties are broken.
PLACES = 9
_SLACK = 2 * 10.0 ** -PLACES
_PAIRS = 100_000


def class_sizes(df: DataFrame, by: str) -> dict:
    """Rows per class; few classes are expected."""
    return {r[by]: r["n"] for r in df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}


def _cuts(block_rows: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A cell's tree: one coordinate a level and the cuts in heap order; none if its sample is all equal."""

    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(sample["vec"].to_numpy())
        bits = min(LEAF_BITS, int(np.ceil(np.log2(sample["n"].iat[0] / block_rows))))
        varied = np.flatnonzero(x.max(axis=0) > x.min(axis=0))
        axes = varied[np.argsort(-x[:, varied].var(axis=0), kind="stable")[:bits]]
        cuts, nodes = [], [x]
        for axis in axes:
            below = []
            for rows in nodes:
                v = np.sort(rows[:, axis])
                cut = v[(len(v) - 1) // 2] if len(v) else 0.0
                if len(v) and cut == v[-1]:
                    # Ties at the top: cut below them, or nowhere if all are equal.
                    lower = v[v < cut]
                    cut = lower[-1] if len(lower) else cut
                cuts.append(float(cut))
                below += [rows[rows[:, axis] <= cut], rows[rows[:, axis] > cut]]
            nodes = below
        return pd.DataFrame({"label": sample["label"].iloc[:1], "cell": sample["cell"].iloc[:1], "axes": [axes.tolist()], "cuts": [cuts]})

    return fit


def place(base: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """Adds ``cell``, the path of a row's cell, to (id, label, vec); and how long a path may be."""
    placed = materialise(base.withColumn("cell", F.lit("")), "placed")
    label = dict(base.dtypes)["label"]
    depth = 0
    while True:
        counts = placed.where(F.length("cell") == depth).groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n"))
        big = materialise(counts.where(F.col("n") > block_rows), "big")
        if big.isEmpty():
            return placed, depth
        sample = placed.join(big, ["label", "cell"]).where(hash_fraction(F.col("id"), f"cell{depth}") < SAMPLE_ROWS / F.col("n"))
        trees = sample.groupBy("label", "cell").applyInPandas(_cuts(block_rows), f"label {label}, cell string, axes array<int>, cuts array<double>")
        trees = materialise(trees.where(F.size("axes") > 0), "trees")
        walk = F.aggregate("axes", F.lit(1), lambda node, axis: node * 2 + (F.get("vec", axis) > F.get("cuts", node - 1)).cast("int"))
        walked = placed.join(trees, ["label", "cell"], "left").withColumn("node", walk)
        path = F.expr("if(axes is null, cell, concat(cell, char(48 + node - shiftleft(1, size(axes)))))")
        placed = materialise(walked.select("id", "label", "vec", path.alias("cell")), "placed")
        depth += 1


def _ends(width: int) -> list[Column]:
    """The least and greatest value of each coordinate, over boxes or rows named lo and hi."""
    return [F.expr(f"array({', '.join(f'{end}({c}[{i}])' for i in range(width))})").alias(c) for end, c in (("min", "lo"), ("max", "hi"))]


def boxes(placed: DataFrame, width: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(label, cell, n, blocks, lo, hi): the cells, written. With no width they have no boxes."""
    rows = placed.select("label", "cell", F.col("vec").alias("lo"), F.col("vec").alias("hi"))
    cells = rows.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n"), *_ends(width))
    return materialise(cells.withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int")), "cells")


def _gap(width: int, lo: Column, hi: Column, lo2: Column, hi2: Column) -> Column:
    """The distance of two boxes."""
    apart = lambda i: F.greatest(F.get(lo2, i) - F.get(hi, i), F.get(lo, i) - F.get(hi2, i), F.lit(0.0))
    return F.sqrt(F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), F.lit(0.0), lambda s, i: s + apart(i) * apart(i)))


def cell_pairs(cells: DataFrame, bounds: DataFrame, width: int, depth: int) -> DataFrame:
    """(label, cell, target, lo, hi): other cells that can hold neighbours of a cell's rows, with the target's box.

    ``bounds`` has the largest ``radius`` that rows of a (label, cell) ask for; cells without one ask for nothing.
    """
    asking = cells.join(bounds, ["label", "cell"], "left")
    pairs = cells.select("label").distinct().select("label", F.lit("").alias("cell"), F.lit("").alias("target"))
    for level in range(1, depth + 1):
        node = F.substring("cell", 1, level)
        nodes = asking.groupBy("label", node.alias("node")).agg(F.max("radius").alias("radius"), *_ends(width))
        nodes = materialise(nodes.withColumn("parent", F.substring("node", 1, level - 1)), "nodes")
        left = nodes.where("radius is not null").select("label", F.col("parent").alias("cell"), F.col("node").alias("a"), "radius", F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
        right = nodes.select("label", F.col("parent").alias("target"), F.col("node").alias("b"), "lo", "hi")
        near = pairs.join(left, ["label", "cell"]).join(right, ["label", "target"])
        near = near.where(_gap(width, F.col("lo_a"), F.col("hi_a"), F.col("lo"), F.col("hi")) <= F.col("radius") + _SLACK)
        pairs = materialise(near.select("label", F.col("a").alias("cell"), F.col("b").alias("target"), "lo", "hi"), "pairs")
        if level < depth:
            pairs = pairs.drop("lo", "hi")
    return pairs.where("cell <> target")


def route(asked: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(id, label, vec, target): rows (id, label, vec, cell, radius) with the cells that their own bounds leave."""
    point = F.col("vec")
    near = asked.join(pairs, ["label", "cell"]).where(_gap(width, point, point, F.col("lo"), F.col("hi")) <= F.col("radius") + _SLACK)
    return near.select("id", "label", "vec", "target")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest of a block of rows for each row of another."""

    def shortlist(q: np.ndarray, me: np.ndarray, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine, theirs = (q * q).sum(axis=1), (x * x).sum(axis=1)
        square = mine[:, None] + theirs - 2 * (q @ x.T)
        square[me[:, None] == ids] = np.inf
        last = min(k, len(ids)) - 1
        kth = np.partition(square, last, axis=1)[:, last]
        # Beyond rounding of the product and of the distances.
        limit = (np.sqrt(np.maximum(kth, 0)) + _SLACK) ** 2 + 1e-11 * (mine + theirs.max())
        return np.nonzero((square <= limit[:, None]) & np.isfinite(square))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        me, ids = left["id"].to_numpy(), right["id"].to_numpy()
        found = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
        if len(me) and len(ids):
            q, x = _matrix(left["vec"]), _matrix(right["vec"])
            for start in range(0, len(me), 512):
                i, j = shortlist(q[start:start + 512], me[start:start + 512], x, ids)
                i = i + start
                parts = [np.sqrt(((x[j[s:s + _PAIRS]] - q[i[s:s + _PAIRS]]) ** 2).sum(axis=1)) for s in range(0, len(i), _PAIRS)]
                distance = np.round(np.concatenate([np.zeros(0), *parts]), PLACES)
                order = np.lexsort((ids[j], distance, i))
                i, j, distance = i[order], j[order], distance[order]
                opens = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else i
                rank = np.arange(len(i)) - np.repeat(opens, np.diff(np.append(opens, len(i))))
                found.append((i[rank < k], ids[j[rank < k]], distance[rank < k]))
        i, neighbour, distance = map(np.concatenate, zip(*found))
        return pa.table({"id": pa.array(me[i]), "label": left["label"].take(pa.array(i)), "neighbour": pa.array(neighbour), "distance": pa.array(distance)})

    return best


def _probe(asked: DataFrame, placed: DataFrame, cells: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(id, label, neighbour, distance): the k best of every block of its target cells for each asked row."""
    label = dict(asked.dtypes)["label"]
    chunks = F.ceil(F.count(F.lit(1)) / block_rows).cast("int")
    plan = materialise(asked.groupBy("label", "target").agg(chunks.alias("chunks")), "load")
    plan = materialise(plan.join(cells.select("label", F.col("cell").alias("target"), "blocks"), ["label", "target"]), "plan")
    part = lambda salt, n: F.pmod(hash_code(F.col("id"), salt), F.col(n)).cast("int").alias(salt)
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    asking = asked.join(plan, ["label", "target"]).select("label", "target", each("blocks", "block"), part("chunk", "chunks"), "id", "vec")
    # New names for the columns, as asked rows may be the placed ones.
    rows = placed.select("id", "label", F.col("cell").alias("target"), "vec").toDF("id", "label", "target", "vec")
    offered = rows.join(plan, ["label", "target"]).select("label", "target", part("block", "blocks"), each("chunks", "chunk"), "id", "vec")
    offered = offered.toDF(*asking.columns[:2], "block", "chunk", "id", "vec")
    keys = ["label", "target", "block", "chunk"]
    return asking.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(_best(k), f"id long, label {label}, neighbour long, distance double")


def nearest(
    rows: DataFrame,
    k: int,
    identity: str,
    vector: str,
    by: str,
    queries: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, label, rank, neighbour, distance): the k nearest other rows of the same class.

    ``queries`` limits whose neighbours are wanted (same columns as ``rows``).
    """
    base = rows.where(F.col(vector).isNotNull()).select(
        F.col(identity).cast("long").alias("id"), F.col(by).alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    placed, depth = place(base, block_rows)
    width = placed.select(F.size("vec")).first()[0] if depth else 0
    cells = boxes(placed, width, block_rows)
    asked = placed if queries is None else placed.join(queries.select(F.col(identity).cast("long").alias("id")).distinct(), "id", "left_semi")
    order = Window.partitionBy("id").orderBy("distance", "neighbour")

    def keep_best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    own = keep_best(_probe(asked.withColumnRenamed("cell", "target"), placed, cells, k, block_rows))
    if not depth:
        return own
    own = materialise(own, "own")
    radius = own.where(F.col("rank") == k).select("id", F.col("distance").alias("radius"))
    asked = asked.join(radius, "id", "left").fillna(float("inf"), ["radius"])
    bounds = asked.groupBy("label", "cell").agg(F.max("radius").alias("radius"))
    routed = materialise(route(asked, cell_pairs(cells, bounds, width, depth), width), "routed")
    return keep_best(own.drop("rank").unionByName(_probe(routed, placed, cells, k, block_rows)))
