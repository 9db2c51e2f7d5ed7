"""Incremental ingest of landed pull-request documents.

Two streams. The first, one for each source and checkpoint, turns documents that arrived since its last run into feature
rows and puts them into the target's inbox. The second belongs to the target: it reads what is new in the inbox, keeps the
rows whose key it has not let through before, and appends them to the target. The keys are its state, kept on disk in its
checkpoint beside the target, so no batch reads the target or the keys of earlier batches again, however much has landed.
As every source passes the same state, a lost checkpoint or another source neither doubles a pull nor loses one.
"""

from __future__ import annotations

from contextlib import AbstractContextManager

from pyspark.sql import DataFrame, SparkSession

from ..plans.pulls import nested_features
from ..session import SMALL_FILES, changed_settings
from ..sources.files import document_options, sound_documents
from ..sources.sinks import landed, one_per_key

KEYS = ["repository_name", "pr_id"]
# Bytes of a batch: some hundred tasks' worth.
BATCH_BYTES = 8 << 30
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stream_settings(spark: SparkSession) -> AbstractContextManager:
    """Settings that streams started meanwhile keep: the keys are on disk, not in memory; and a batch of many files is
    looked up by a few tasks a core, not by one task a file, and read by tasks of many files."""
    return changed_settings(spark, {PROVIDER: ROCKS, LISTING: str(8 * spark.sparkContext.defaultParallelism), **SMALL_FILES})


def ingest_documents(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int | None = None,
                     multi_line: bool = True, batch_bytes: int = BATCH_BYTES) -> list[int]:
    """Turn documents that arrived since the last run into feature rows; pulls already there are skipped.

    Of several documents of one pull the first to land stays, of those that land in one batch the one with the smallest
    row. A batch that is run again changes nothing. Returns the rows that each batch of the target's stream read.

    A batch is bounded by ``batch_bytes``, as its work is, or by ``files_per_batch`` files if that is given: a document may be
    a file of its own, and a batch of few such files costs its fixed time for a few rows.
    """
    inbox = f"{target}/_inbox"
    bound = ("maxBytesPerTrigger", batch_bytes) if files_per_batch is None else ("maxFilesPerTrigger", files_per_batch)
    reader = spark.readStream.option(*bound)
    stream = sound_documents(document_options(reader, multi_line).json(source), source)

    def put(batch: DataFrame, batch_id: int) -> None:
        one_per_key(nested_features(batch), KEYS).write.mode("append").parquet(inbox)

    with _stream_settings(spark):
        landing = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        landing.awaitTermination()
    waiting = landed(spark, inbox)
    return [] if waiting is None else _admit(spark, inbox, waiting.schema, target, bound)


def _admit(spark: SparkSession, inbox: str, schema, target: str, bound: tuple) -> list[int]:
    """Append the inbox's rows of new keys; files of the inbox go once their batch is done."""
    rows = spark.readStream.schema(schema).option(*bound).option("cleanSource", "delete").parquet(inbox)
    with _stream_settings(spark):
        query = (rows.dropDuplicates(KEYS).writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{target}/_ledger")
                 .outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()
    return [p["numInputRows"] for p in query.recentProgress]
