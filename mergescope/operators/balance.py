"""Splits, folds and class balancing. All draws are hashes of row ids, all counts are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .hashing import hash_code, hash_fraction, slice_by_hash
from .neighbours import class_sizes, nearest


def is_test_row(identity: Column, percent: int = 20, salt: str = "") -> Column:
    return F.pmod(hash_code(identity, salt), F.lit(100)) < percent


def random_split(df: DataFrame, identity: str, percent: int = 20, salt: str = "") -> tuple[DataFrame, DataFrame]:
    """(train, test) by hash; neither shuffles."""
    test = is_test_row(F.col(identity), percent, salt)
    return df.where(~test), df.where(test)


def stratified_split(df: DataFrame, identity: str, label: str, fraction: float = 0.2) -> DataFrame:
    """Add ``is_test`` for exactly round(fraction * n) rows of each class."""
    cut = F.floor(F.col("n") * F.lit(fraction) + F.lit(0.5))
    return slice_by_hash(df, identity, label, [cut], out="_slice").withColumn("is_test", F.col("_slice") == 0).drop("_slice")


def stratified_folds(df: DataFrame, identity: str, label: str, k: int = 5, out: str = "fold") -> DataFrame:
    """Fold number 0..k-1; within each class the folds' sizes differ by at most one."""
    cuts = [F.floor(F.col("n") * i / F.lit(k)) for i in range(1, k)]
    return slice_by_hash(df, identity, label, cuts, salt="fold", out=out)


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def smallest_class(df: DataFrame, label: str) -> DataFrame:
    return class_distribution(df, label).agg(F.min("n").alias("n"))


def _copies(df: DataFrame, identity: str, label: str, target: Column, salt: str) -> DataFrame:
    """Add ``_copies``: how often a row is to be drawn so that its class gains target - n rows."""
    need = F.greatest(target - F.col("n"), F.lit(0))
    sizes = materialise(class_distribution(df, label), "sizes")
    sliced = slice_by_hash(df, identity, label, [F.pmod(need, F.col("n"))], salt, "_slice", class_sizes=sizes)
    whole = F.floor(need / F.col("n")).cast("int")
    counted = sliced.join(sizes.select(label, whole.alias("_whole")), label)
    return counted.withColumn("_copies", F.col("_whole") + (F.col("_slice") == 0).cast("int")).drop("_slice", "_whole")


def random_oversample(df: DataFrame, identity: str, label: str, salt: str = "over") -> DataFrame:
    """Repeat rows until every class has as many as the largest; ``copy`` is 0 for the original."""
    largest = max(class_sizes(df, label).values())
    drawn = _copies(df, identity, label, F.lit(largest), salt)
    return drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies")))).select(*df.columns, "copy")


def extreme_classes(sizes: dict) -> tuple:
    """(smallest, largest) class; the smaller label among equals."""
    return min(sizes, key=lambda c: (sizes[c], c)), min(sizes, key=lambda c: (-sizes[c], c))


def random_undersample(df: DataFrame, identity: str, label: str, salt: str = "under") -> DataFrame:
    """Reduce the largest class to the size of the smallest."""
    sizes = class_sizes(df, label)
    smallest, largest = extreme_classes(sizes)
    quota = F.when(F.col(label) == F.lit(largest), F.lit(sizes[smallest])).otherwise(F.col("n"))
    return slice_by_hash(df, identity, label, [quota], salt, "_slice").where(F.col("_slice") == 0).drop("_slice")


def smote(
    df: DataFrame,
    identity: str,
    label: str,
    vector: str,
    k: int = 5,
    minority_only: bool = False,
    salt: str = "smote",
    **options,
) -> DataFrame:
    """Originals plus synthetic rows so that all classes (or only the smallest) reach the largest one's size.

    A synthetic row lies between a row and one of its ``min(k, smallest class - 1)`` nearest neighbours of the
    same class. Columns: (id, label, vec, base_id, neighbour_id, copy); the last three are null for originals.
    """
    sizes = materialise(class_distribution(df, label).withColumnRenamed(label, "label"), "sizes")
    first = F.min_by("label", F.struct("n", "label"))
    least, most, smallest = sizes.agg(F.min("n"), F.max("n"), first).first()
    k = min(k, (least or 0) - 1)
    if k < 1:
        raise ValueError("the smallest class needs two rows at least")
    originals = df.select(F.col(identity).alias("id"), F.col(label).alias("label"),
                          F.col(vector).cast("array<double>").alias("vec"))
    none = F.lit(None).cast("long")
    kept = originals.withColumns({"base_id": none, "neighbour_id": none, "copy": F.lit(None).cast("int")})
    if least == most:
        return kept
    grown = F.col("label") == F.lit(smallest) if minority_only else F.col("n") < most
    pool = originals.join(sizes.where(grown), "label").drop("n")
    base = _copies(pool, "id", "label", F.lit(most), salt).where(F.col("_copies") > 0)
    near = nearest(pool, k, "id", "vec", "label", queries=base, **options)
    drawn = base.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    draw = F.concat(F.col("id").cast("string"), F.lit("-"), F.col("copy").cast("string"))
    drawn = drawn.withColumns({"rank": F.pmod(hash_code(draw, "neighbour"), F.lit(k)).cast("int") + 1, "_gap": hash_fraction(draw, "gap")})
    other = originals.select(F.col("id").alias("neighbour"), F.col("vec").alias("_to"))
    drawn = drawn.join(near.select("id", "rank", "neighbour"), ["id", "rank"]).join(other, "neighbour")
    made = drawn.select(
        none.alias("id"), "label", F.zip_with("vec", "_to", lambda a, b: a + F.col("_gap") * (b - a)).alias("vec"),
        F.col("id").alias("base_id"), F.col("neighbour").alias("neighbour_id"), "copy",
    )
    return kept.unionByName(made)


def over_then_under(df: DataFrame, identity: str, label: str, vector: str, k: int = 5, **options) -> DataFrame:
    """Grow the smallest class by interpolation, then cut the largest to the smallest.

    The grown table is written once; which rows of the largest class stay goes by the hash of ``key``, the id of an
    original row and base and copy of a synthetic one.
    """
    grown = smote(df, identity, label, vector, k, minority_only=True, **options)
    key = F.coalesce(F.col("id").cast("string"), F.concat_ws("-", "base_id", "copy"))
    return random_undersample(materialise(grown.withColumn("key", key), "grown"), "key", "label")
