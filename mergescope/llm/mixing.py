"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key of its id, text and a seed. Documents are range-sorted by source and key, and two
levels of prefix sums (of the range partitions, and within each) give the words that lie before a document in its source.
A source's budget is cut exactly there: it takes whole epochs of the source, then the documents before the cut once more
and the first words of the document at the cut. A hot source is many range partitions, so no task holds one.

A source's share is its weight's part of all words, at most ``epochs`` times the source; what is beyond is shared again by
weight among the others until none is above. The same rows, seed and weights always give the same mix.

Null text has no words and takes none. Null source is a source of its own, the last one. Rows that agree in id, source
and text stand together in the order and are counted before they are sorted, so any number of them is one row there; each
gets its result. Null doc_id is an id like others. An empty table gives no rows; without words all targets are 0. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"
SOURCE = ["none", "src"]
# Copies of one row that are dealt out at a time.
COPIES = 1000


def counted(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(none, src, doc_id, key, size, n): documents with their key and words; n rows are alike."""
    text = F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)))
    rows = docs.select(
        F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("src"), "doc_id", key.alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    return rows.groupBy(*SOURCE, "doc_id", "key", "size").agg(F.count("*").alias("n"))


def ranged(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows sorted over all partitions and written; ``part`` numbers the partitions in that order."""
    return materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), name)


def numbered(sources: DataFrame) -> DataFrame:
    """Sources with their place in code point order, from 0; only one row a partition is counted together."""
    parts = ranged(sources, SOURCE, "sources")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("offset"))
    at = F.row_number().over(Window.partitionBy("part").orderBy(*SOURCE)) - 1
    return parts.withColumn("at", at).join(offsets, "part").select(*sources.columns, (F.col("at") + F.col("offset")).alias("at"))


def repeating(at: Column) -> Column:
    """The weight of the source at a place: 1, 2, 3, 1, ..."""
    return F.element_at(F.array(*map(F.lit, WEIGHTS)), (at % len(WEIGHTS) + 1).cast("int"))


def targets(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Adds ``target`` to sources with ``words`` and an integer ``weight`` above 0.

    Each round knows the share of one unit of weight, and finds the sources that it lifts above their limit; they stop
    there and the unit's share grows for the others, until no further source is above. Only sums reach the driver.
    """
    sources = materialise(sources, "weights")
    total, weight = sources.selectExpr("coalesce(sum(words), 0)", "coalesce(sum(weight), 0)").first()
    over = "cast({} as decimal(19, 0)) * cast(weight as decimal(10, 0)) > {} * cast(words as decimal(18, 0)) * cast({} as decimal(12, 0))"
    rest, units = total, weight
    while True:
        above = over.format(rest, epochs, units)
        words, heavy = sources.where(above).selectExpr("coalesce(sum(words), 0)", "coalesce(sum(weight), 0)").first()
        if (total - epochs * words, weight - heavy) == (rest, units):
            break
        rest, units = total - epochs * words, weight - heavy
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(units or 1))
    return sources.withColumn("target", F.when(F.expr(above), epochs * F.col("words").cast("double")).otherwise(share))


def mix(docs: DataFrame, weight: Callable[[Column], Column] = repeating, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): the words that the mix takes of each document, with repeats.

    ``weight`` gives the weight of a source from its place in order.
    """
    rows = ranged(materialise(counted(docs, seed), "sizes"), [*SOURCE, "key", "doc_id"], "sorted")
    sums = materialise(rows.groupBy(*SOURCE, "part").agg(F.sum(F.col("size") * F.col("n")).alias("words")), "sums")
    sources = numbered(sums.groupBy(*SOURCE).agg(F.sum("words").alias("words"))).withColumn("weight", weight(F.col("at")))
    budgets = targets(sources, epochs).select(*SOURCE, F.col("words").alias("source_size"), "target")
    before = Window.partitionBy(*SOURCE).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(budgets, SOURCE)
    ahead = Window.partitionBy(*SOURCE, "part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum(F.col("size") * F.col("n")).over(ahead), F.lit(0))).join(parts, [*SOURCE, "part"])
    # Alike rows come one after another, dealt out in two steps as there may be very many.
    rows = rows.withColumn("block", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")))
    rows = rows.withColumn("copy", F.explode(F.expr(f"sequence(block * {COPIES}, least(n - 1, block * {COPIES} + {COPIES - 1}))")))
    budget = "cast(floor(target) as bigint)"
    start = "(before + ahead + copy * size)"
    return rows.select(
        "doc_id", F.when(~F.col("none"), F.col("src")).alias("source"), "size", "source_size", "target",
        F.expr(f"""case when source_size = 0 then 0L else {budget} div source_size * size
            + greatest(0L, least(size, {budget} % source_size - {start})) end""").alias("taken"))


SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    md5('{SEED}' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS k FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
r AS (
  SELECT *, sum(source_size) OVER () - {EPOCHS} * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS units
  FROM s WINDOW o AS (ORDER BY source_size / w, source NULLS LAST)),
c AS (SELECT *, rest * w > {EPOCHS} * source_size * units AS above FROM r),
f AS (SELECT rest, units FROM c WHERE NOT above ORDER BY units DESC LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN above THEN {EPOCHS} * source_size::DOUBLE ELSE f.rest::DOUBLE * w / f.units::DOUBLE END AS target
  FROM c, f),
p AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM d)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE floor(target)::BIGINT // source_size * size
  + greatest(0, least(size, floor(target)::BIGINT % source_size - ahead)) END::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source"""
