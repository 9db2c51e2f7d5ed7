"""Running totals and dense ranks over any number of ordered rows.

A window without partitions is one task. Here rows are range-partitioned, each range is totalled, and the totals
of the ranges before it are added to a window that stays inside the range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, task_count


def running_totals(
    df: DataFrame,
    order: list[str],
    totals: dict[str, str],
    by: list[str] | None = None,
    descending: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``name`` = running total of ``column`` for each pair in ``totals``, from the first row to this one.

    ``order`` must be unique within ``by``; aggregate to one row per key first, which also removes hot keys.
    Only few ``by`` groups are expected (classes, columns): one offset row exists per group and range.
    """
    spark = df.sparkSession
    by = by or []
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by] + [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    # Range bounds come from a sample, so the assignment is written once and then only read.
    ranged = materialise(df.repartitionByRange(partitions, *keys).withColumn("_range", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*by, "_range")
        .agg(*[F.sum(column).alias(f"_sum_{name}") for name, column in totals.items()])
        .select(*by, "_range", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in totals])
    )
    inside = Window.partitionBy(*by, "_range").orderBy(*keys[len(by):]).rowsBetween(Window.unboundedPreceding, 0)
    # At most ranges + groups rows, as ranges are contiguous in (by, order); written, so that Spark knows the size.
    joined = ranged.join(materialise(offsets, "offsets"), [*by, "_range"])
    return joined.select(
        *df.columns,
        *[(F.sum(column).over(inside) + F.col(f"_off_{name}")).alias(name) for name, column in totals.items()],
    )


def dense_ranks(values: DataFrame, value: str, by: list[str], out: str = "code", max_rows: int = 100_000) -> DataFrame:
    """Rank from 0 of distinct values within ``by``. ``values``, a written table, holds one row per distinct value."""
    rows = values.count()
    if rows <= max_rows:
        return values.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(value)).cast("long") - 1)
    counted = running_totals(values.withColumn("_one", F.lit(1)), [value], {out: "_one"}, by, partitions=task_count(values.sparkSession, rows))
    return counted.select(*values.columns, (F.col(out) - 1).cast("long").alias(out))
