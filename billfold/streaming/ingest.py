"""Incremental ingest of new documents as a stream."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from billfold.plans.stages import PageInputs, RunOptions, ingest
from billfold.sources.files import file_rows, folder_glob, read_documents
from billfold.sources.store import BillingStore

_BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_documents(spark: SparkSession, path: str, files_per_batch: int = 10_000) -> DataFrame:
    """New files of a folder as documents."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(_BINARY_FILE)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder_glob(path))
    )
    return read_documents(file_rows(files))


def ingest_stream(
    docs: DataFrame,
    store: BillingStore,
    checkpoint: str,
    options: RunOptions | None = None,
    pages: PageInputs | None = None,
) -> StreamingQuery:
    """Starts the ingest of a stream of documents; stops when all there is has been read.

    The stream itself keeps no state: what was seen is the stored invoice table, which
    every micro-batch is checked against by content hash. The batch id names the folder
    the batch is written to, so a replayed batch replaces itself. PDF and image files need
    ``pages``, tables that hold what was found in them by the time their batch runs.
    """
    base = options or RunOptions()

    def add(batch: DataFrame, epoch: int) -> None:
        ingest(store, batch, pages, replace(base, batch=f"stream-{epoch:012d}"))

    return (
        docs.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
