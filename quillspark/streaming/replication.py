"""Replicas of key-value logs by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.kv import SCHEMA, Log, newest


def stream(spark: SparkSession, operations: str, max_files: int = 1000) -> DataFrame:
    """A log's operations as they are appended."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).parquet(operations)


def replicate(source: Log, replica: Log, checkpoint: str, *, once: bool = False, interval: str | None = None) -> StreamingQuery:
    """Append each batch's newest operations to the replica's log.

    The highest (seq, node) of a key wins whenever its batch arrives, and a batch that is repeated
    after a failure adds nothing, so order, delay and duplicates don't change what a replica holds.
    A replica starts from the source's snapshot, and the source's compaction keeps the operations
    that a replica has not read (``Log.forget`` ends that). ``once``: all that is there now, then stop.
    """
    with source.lock:
        source.flush()
        source.register(checkpoint)
        before = None if replica.files.list(f"{checkpoint}/commits") else source.snapshot()
        if before is not None:
            before.write.mode("append").parquet(replica.operations)

    def apply(batch: DataFrame, _: int) -> None:
        newest(batch).select(*SCHEMA.names).write.mode("append").parquet(replica.operations)

    replica.files.write(f"{replica.folder}/.created", "")
    writer = stream(source.spark, source.operations).writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    if once:
        writer = writer.trigger(availableNow=True)
    elif interval:
        writer = writer.trigger(processingTime=interval)
    return writer.start()
