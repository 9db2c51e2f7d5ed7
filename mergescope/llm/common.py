"""What several operators of this subpackage share: tables, word rules, hashing and grouping of linked ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, prepare

# Rows per Arrow batch: bounds what a Python worker holds, as texts may be long.
BATCH_ROWS = 500
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def setup(spark: SparkSession) -> SparkSession:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return setup(spark).read.parquet(f"{sf}/{name}.parquet")


def spread_scan(df: DataFrame) -> DataFrame:
    """Deal a scan of fewer tasks than cores out to all cores, evenly and without a key."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def lower_ascii(text: Column) -> Column:
    return F.translate(text, *LOWER)


def words(text: Column, separators: str) -> Column:
    """Words between runs of separators; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def arrow(df: DataFrame, function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Apply a function to each Arrow batch of a table."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                yield from function(pa.Table.from_batches([batch])).combine_chunks().to_batches()

    return df.mapInArrow(batches, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def rolling(a: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash modulo 2^64 of every run of ``size`` symbols, by doubling."""
    base = 0x9E3779B97F4A7C15
    powers = {1: a}
    length, p, bases = 1, base, {1: base}
    while length * 2 <= size:
        h = powers[length]
        powers[length * 2] = h[:-length] * np.uint64(p) + h[length:]
        length, p = length * 2, p * p & 0xFFFFFFFFFFFFFFFF
        bases[length] = p
    done, at = None, 0
    for l in sorted(powers, reverse=True):
        if size & l:
            part = powers[l]
            if done is None:
                done = part
            else:
                m = len(a) - at - l + 1
                done = done[:m] * np.uint64(bases[l]) + part[at:at + m]
            at += l
    return done


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    m, l = h, 1
    while l * 2 <= width:
        m = np.minimum(m[:-l], m[l:])
        l *= 2
    return np.minimum(m[:len(m) - (width - l)], m[width - l:]) if l < width else m


def components(spark: SparkSession, links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of links (a, b), a != b: rows (id, component), the smallest id reachable.

    Alternating large-star and small-star rounds: each is one aggregation of the smallest neighbour and one join, so no
    component gathers in one task, and the rounds grow with the logarithm of the longest chain. Every round is written
    to the shared folder, so a lost executor costs one round at most.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialise(edges, name)
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every larger neighbour, and the node itself, link to the smallest of the neighbourhood.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = materialise(large.distinct(), name)
        # Small star: every smaller neighbour, and the node itself, link to the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        after = materialise(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), name)
        mark = ["count(*) n", "coalesce(sum(cast(xxhash64(a, b) as decimal(38, 0))), 0) s"]
        if edges.selectExpr(*mark).first() == after.selectExpr(*mark).first():
            return after.select(F.col("a").alias("id"), F.col("b").alias("component"))
        edges = after


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def by_group(df: DataFrame, keys: list[str], function: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """Apply a function to the rows of each key, one key at a time from sorted partitions.

    Unlike one call per group through Spark, many small groups share an Arrow batch. A key's rows must fit a task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []

        def of(part: pd.DataFrame) -> pd.DataFrame | None:
            out = function(part.reset_index(drop=True))
            return out if out is not None and len(out) else None

        for batch in batches:
            if not len(batch):
                continue
            if rest and any(batch[k].iat[0] != rest[0][k].iat[0] for k in keys):
                done = of(pd.concat(rest))
                rest = []
                if done is not None:
                    yield done
            change = np.zeros(len(batch), bool)
            for k in keys:
                v = batch[k].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(change).tolist()
            if not starts:
                rest.append(batch)
                continue
            outs = [of(pd.concat([*rest, batch.iloc[:starts[0]]]))]
            outs += [of(batch.iloc[s:e]) for s, e in zip(starts, starts[1:])]
            rest = [batch.iloc[starts[-1]:]]
            outs = [o for o in outs if o is not None]
            if outs:
                yield pd.concat(outs)
        if rest:
            done = of(pd.concat(rest))
            if done is not None:
                yield done

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, packed): texts compressed for a shuffle; ``row`` is the text's hash."""

    def run(t: pa.Table) -> pa.Table:
        pack = zstandard.ZstdCompressor(level=3).compress
        z = [pack((x or "").encode("utf-8", "surrogatepass")) for x in t.column("text").to_pylist()]
        return t.select(["doc_id", "row"]).append_column("packed", pa.array(z, pa.binary()))

    return arrow(docs.select("doc_id", F.xxhash64("text").alias("row"), "text"), run, "doc_id long, row long, packed binary")


def unpack(column: pa.ChunkedArray | pd.Series) -> Iterator[bytes]:
    """Texts of a packed column in UTF-8, one at a time."""
    return map(zstandard.ZstdDecompressor().decompress, column.to_pylist() if hasattr(column, "to_pylist") else column)


def covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    """Which of n places lie in one of the spans [start, end)."""
    edge = np.zeros(n + 1, np.int64)
    for s, e in spans:
        edge[s] += 1
        edge[e] -= 1
    return np.cumsum(edge)[:n] > 0
