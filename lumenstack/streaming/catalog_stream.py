"""Streaming forms of the scan and the change cursor (SRC-3, ST-1, ST-2, ST-24).

Files (or event rows) arrive as a stream; each micro-batch is classified like a batch scan, gets the
next revisions and is appended to a change table. Readers poll pages of that table by revision. The
revision that a batch starts from is stored with the batch, so a batch that is run again after a
failure overwrites its own folder and keeps its numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenstack.operators.catalog import delta_page, latest, with_revisions
from lumenstack.session import path_exists


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_changes(stream: DataFrame, table: str, checkpoint: str, order: list[str], classify: Callable[[DataFrame], DataFrame] = lambda df: df, poll: str | None = None) -> StreamingQuery:
    """Append each micro-batch, with revisions, to `table/batch=<id>`; `poll` is a trigger interval, without it all that is there is read once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = 0
        if path_exists(spark, table):
            before = spark.read.parquet(table).where(F.col("batch") < batch_id).agg(F.max("revision")).first()[0] or 0
        with_revisions(classify(batch), order, before).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


def page_of(spark: SparkSession, table: str, keys: list[str], since: int | None, limit: int | None) -> tuple[DataFrame, dict]:
    """A page of the latest entries of a change table above a cursor."""
    return delta_page(latest(spark.read.parquet(table).drop("batch"), keys, "revision"), since, limit)


def running_counts(stream: DataFrame, by: list[str], table: str, checkpoint: str) -> StreamingQuery:
    """Counts by key over the whole stream, kept in state and rewritten after each batch (AGG-6 as a stream)."""
    counts = stream.groupBy(*by).agg(F.count("*").alias("n"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(table)

    return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
