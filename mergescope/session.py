"""Session settings and the shared folder for intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on; all can be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# For scans of small files: opening one takes as long as reading so many bytes. By Spark's own 4 MB a task gets a few files only.
SMALL_FILES = {"spark.sql.files.openCostInBytes": "64k"}

# Rows of a join or a grouping that one task is given, so that its memory does not grow with the table.
ROWS_PER_TASK = 500_000


def build_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and benchmarks; on a cluster the launcher supplies the session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("mergescope")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        # Recording the Python call site of every expression slows plan building several times over.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session someone else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session.

    Only a local session may go without the setting; it then gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    active = sc.getCheckpointDir()
    if active is None:
        if configured is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="mergescope-")
        sc.setCheckpointDir(configured)
        active = sc.getCheckpointDir()
    return configured or active


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier job has used."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def task_count(spark: SparkSession, rows: int) -> int | None:
    """Tasks of ``ROWS_PER_TASK`` rows; none for a table that has no more of them than there are cores."""
    tasks = -(-rows // ROWS_PER_TASK)
    return tasks if tasks > spark.sparkContext.defaultParallelism else None


@contextmanager
def cut_by_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Settings for a job over so many rows: shuffles have one partition for each ``ROWS_PER_TASK`` of a large table,
    and scans small splits, as each groups its rows in memory before a shuffle.

    Their usual number is the session's, whatever the input, and adaptive execution joins them up to a size in compressed
    bytes, so that a task sorts more rows the larger the table is. Hot keys are divided from a lower size on.
    """
    tasks = task_count(spark, rows)
    changed = {} if tasks is None else {
        "spark.sql.shuffle.partitions": str(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))),
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16m",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
        "spark.sql.files.maxPartitionBytes": "16m",
    }
    with changed_settings(spark, changed):
        yield


@contextmanager
def changed_settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings for what is planned meanwhile, and for streams that are started."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialise(df: DataFrame, name: str = "table", rows: int = 0) -> DataFrame:
    """Write a table that several passes read to the shared folder and read it from there.

    The passes then read only the columns they need, and nothing upstream runs twice or is lost with an executor. ``rows``,
    the size of the largest table that goes in, keeps the memory of a task from growing with it.
    """
    path = new_path(df.sparkSession, name)
    with cut_by_rows(df.sparkSession, rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a scan with fewer tasks than there are cores one task per core, by a shuffle on a unique key.

    Text rules are bound by processors, and a single file of a few megabytes is read by one task. A table of cluster
    size has more tasks than cores and stays as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
