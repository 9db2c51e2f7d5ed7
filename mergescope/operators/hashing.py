"""Seedless randomness: every draw is a hash of a row's id, so reruns and other engines agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

HASH_RANGE = 1 << 32


def hash_code(identity: Column, salt: str = "") -> Column:
    """First 32 bits of the MD5 of the id, as a non-negative long."""
    text = identity.cast("string")
    text = F.concat(text, F.lit(salt)) if salt else text
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def hash_fraction(identity: Column, salt: str = "") -> Column:
    return hash_code(identity, salt) / F.lit(float(HASH_RANGE))


def slice_by_hash(
    df: DataFrame,
    identity: str,
    by: str,
    cuts: list[Column],
    salt: str = "",
    out: str = "slice",
    bits: int | None = None,
    class_sizes: DataFrame | None = None,
) -> DataFrame:
    """Cut every class, ordered by (hash, id), at exact positions; ``out`` is the number of cuts at or before a row.

    ``cuts`` are ascending positions as expressions over ``n``, the class size (and the columns of
    ``class_sizes`` if given: one row per class with ``n``). Few classes are expected.

    Rows are counted per hash bucket, which leaves at most classes x 2^bits counts. A bucket without a cut inside
    needs no ordering: its rows get their slice with no shuffle. Only the buckets that a cut splits are sorted, a
    2^-bits share of a class each, so a class of any size never meets in one task. Unless given, ``bits`` follows
    the number of rows: buckets of some hundreds of rows, but no more than 2^16 buckets.
    """
    bits = bits or min(16, max(6, (df.select(by).count() // 256).bit_length()))
    bucket = F.shiftright(F.col("_hash"), 32 - bits)
    hashed = df.withColumn("_hash", hash_code(F.col(identity), salt)).withColumn("_bucket", bucket)
    counts = hashed.groupBy(by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    if class_sizes is None:
        class_sizes = counts.groupBy(by).agg(F.sum("_size").alias("n"))
    running = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    located = counts.withColumn("_end", F.sum("_size").over(running)).join(class_sizes, by)
    start, end = F.col("_end") - F.col("_size"), F.col("_end")
    first = sum(((cut <= start).cast("int") for cut in cuts), F.lit(0))
    last = sum(((cut < end).cast("int") for cut in cuts), F.lit(0))
    located = located.select(
        by, "_bucket", start.alias("_start"), first.alias("_first"), last.alias("_last"),
        F.array(*[cut.cast("long") for cut in cuts]).alias("_cuts"),
    )
    # Written, so that Spark knows how large it is and broadcasts it only below its limit.
    placed = hashed.join(materialise(located, "located"), [by, "_bucket"])
    whole = placed.where(F.col("_first") == F.col("_last")).select(*df.columns, F.col("_first").alias(out))
    within = Window.partitionBy(by, "_bucket").orderBy("_hash", identity)
    position = F.col("_start") + F.row_number().over(within) - 1
    split = (
        placed.where(F.col("_first") < F.col("_last"))
        .withColumn("_position", position)
        .select(*df.columns, F.size(F.filter("_cuts", lambda cut: cut <= F.col("_position"))).alias(out))
    )
    return whole.unionByName(split)
