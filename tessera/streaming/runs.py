"""Event streams: counts by type and window with late events up to a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of a stream or a table of events."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    counted = seen.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str) -> None:
    """Reads what is new under source and appends closed windows to sink, once each."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = windowed(stream).writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def consume(spark: SparkSession, queue: str, statuses: str, forward: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], schema: str = "job_id string, payload string") -> None:
    """Works on the messages (JSON lines) that have come to queue since the last call, and records what became of each.

    work gives the batch's rows with a column error, null where all went well: one bad job does not stop the others. Statuses
    (job_id, status, error) and the messages of jobs that are done, for the next queue, are written for each batch under its own
    name, so that a batch that is repeated after a loss replaces itself.
    """

    def handle(batch: DataFrame, number: int) -> None:
        done = work(batch.dropDuplicates(["job_id"]).where("job_id is not null")).persist()
        status = F.when(F.col("error").isNull(), "done").otherwise("failed")
        done.select("job_id", status.alias("status"), "error").write.mode("overwrite").parquet(f"{statuses}/batch={number}")
        done.where("error is null").select(*batch.columns).write.mode("overwrite").json(f"{forward}/batch={number}")
        done.unpersist()

    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(queue)
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
