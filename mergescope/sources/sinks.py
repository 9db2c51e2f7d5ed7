"""Writers, and appending only what is new."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.unions import union_tables
from ..session import changed_settings

# Characters that folder names of partitions hold as %XX, and the folder of rows without a value, as in Spark's own writers.
ESCAPED = re.compile(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]")
NO_FOLDER = "__HIVE_DEFAULT_PARTITION__"
# Rows that a task holds while it writes each to a file.
ROWS_HELD = 256


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Each part file carries its own header, so a folder grown by appends reads as one table."""
    df.write.mode("append").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_by_repository(df: DataFrame, path: str, column: str = "repository_name") -> None:
    """One folder per repository. Rows are not shuffled for it: a repository that holds most rows is written by
    many tasks."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def rewrite_with(old: DataFrame, new: DataFrame, path: str) -> None:
    """Old and new rows under the union of their columns, at a new path."""
    union_tables([old, new]).write.mode("errorifexists").parquet(path)


def landed(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the smallest by its other columns in order, whatever order the rows come in."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    return df.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_row")).select(*[c if c in keys else f"_row.{c}" for c in df.columns])


def only_new(df: DataFrame, known: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows whose key has not landed, one per key."""
    fresh = one_per_key(df, keys)
    return fresh if known is None else fresh.join(known.select(*keys), keys, "left_anti")


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    only_new(df, landed(df.sparkSession, path), keys).write.mode("append").parquet(path)


@dataclass
class RowFiles:
    """A writer of one row a file, under one folder a value of ``folder``.

    Spark's writers end a file with a commit of its own, and on local disks start processes to set permissions, which takes
    many times as long as the few bytes of a row. Here a task writes its files one after the other. Their names hold the
    partition and the row's place in it, so a task that runs again writes the same files.
    """

    rows: DataFrame
    folder: str

    def text(self, root: str) -> None:
        """The only other column, as text."""
        value, = (c for c in self.rows.columns if c != self.folder)
        self._write(root, F.col(value), "txt")

    def json(self, root: str) -> None:
        """The other columns as an indented object; null fields are left out."""
        others = [c for c in self.rows.columns if c != self.folder]
        self._write(root, F.to_json(F.struct(*others), {"pretty": "true"}), "json")

    def _write(self, root: str, value: Column, extension: str) -> None:
        name, job = self.folder, uuid.uuid4().hex
        rows = self.rows.select(F.col(name).cast("string").alias("folder"), F.coalesce(value, F.lit("")).cast("binary").alias("data"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, top = fs.FileSystem.from_uri(re.sub(r"^(file:)?/+", "file:///", root))
            part, paths, n = TaskContext.get().partitionId(), {}, 0
            for batch in batches:
                for value, data in zip(batch.column("folder").to_pylist(), batch.column("data")):
                    if value not in paths:
                        shown = ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", value) if value else NO_FOLDER
                        paths[value] = f"{top}/{name}={shown}"
                        store.create_dir(paths[value], recursive=True)
                    with store.open_output_stream(f"{paths[value]}/part-{part:05d}-{job}-{n:07d}.{extension}", compression=None) as out:
                        out.write(data.as_buffer())
                        out.write(b"\n")
                    n += 1
            yield pa.RecordBatch.from_pydict({"n": [n]}, pa.schema([("n", pa.int64())]))

        with changed_settings(rows.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS_HELD)}):
            rows.mapInArrow(run, "n long").agg(F.sum("n")).first()
