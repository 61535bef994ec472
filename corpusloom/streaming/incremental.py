"""Incremental ingestion with Structured Streaming: resume by checkpoint, idempotent append by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import append_documents


def ingest(spark: SparkSession, landing: str, schema, sink: str, checkpoint: str, key: str, order: str, files_per_trigger: int = 100, transform=lambda df: df) -> None:
    """Process what landed since the last call, exactly once by checkpoint and by key at the sink; returns when it is done."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(landing)
    query = (
        transform(stream).writeStream.foreachBatch(lambda batch, _: append_documents(batch, sink, key, order))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per type and window; works on batches and on streams with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def next_status(status, outcome):
    """unfinished -> success, failed or corrupted; only success is final."""
    return F.when(status == "success", status).otherwise(F.when(outcome == "success", "success").when(outcome == "corrupted", "corrupted").otherwise("failed"))
