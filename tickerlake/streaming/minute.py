"""Streaming per-minute counts with a watermark.

Events (from the lake's raw files or a landing stream) are counted per
(source, minute) with ``withWatermark`` so the state of closed minutes is
dropped. The query runs in update mode: each micro-batch writes the
windows it changed to ``{out}/batch_id=N`` (overwrite, so a replayed batch
is harmless), and ``read_minute_counts`` keeps the newest value per window.
That answer equals the batch aggregate for every event that arrived before
its window's watermark passed; later events are dropped by design.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T



def minute_count_updates(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Streaming aggregate: (source, minute, n) per 1-minute event-time window."""
    # Watermarks need a zoned TIMESTAMP; outputs are cast back to naive UTC.
    e = events.withColumn("_event_time", F.timestamp_millis(F.col("event_ts")))
    return (
        e.withWatermark("_event_time", watermark)
        .groupBy(F.window("_event_time", "1 minute").alias("w"), "source")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("source", F.col("w.start").cast("timestamp_ntz").alias("minute"), "n")
    )


def start_minute_counts(
    spark: SparkSession,
    events: DataFrame,
    out: str,
    checkpoint: str,
    watermark: str = "10 minutes",
    trigger: dict | None = None,
):
    """Start the update-mode stream; returns the StreamingQuery."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        minute_count_updates(events, watermark)
        .writeStream.outputMode("update")
        .foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_minute_counts(spark: SparkSession, out: str) -> DataFrame:
    """Latest value per (source, minute) across the update batches."""
    schema = T.StructType(
        [
            T.StructField("source", T.StringType()),
            T.StructField("minute", T.TimestampNTZType()),
            T.StructField("n", T.LongType()),
            T.StructField("batch_id", T.LongType()),
        ]
    )
    u = spark.read.schema(schema).parquet(out)
    return u.groupBy("source", "minute").agg(F.max_by("n", "batch_id").alias("n"))
