"""Message counts per time window, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def activity(messages: DataFrame, length: str = "1 hour") -> DataFrame:
    """Messages per window and chatroom; also valid on a stream with a watermark."""
    counts = messages.groupBy(F.window("create_time", length).alias("_w"), "chatroom").agg(
        F.count(F.lit(1)).alias("messages")
    )
    return counts.select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
        "chatroom", "messages",
    )


def upsert_activity(
    messages: DataFrame, log: str, checkpoint: str, length: str = "1 hour", lateness: str = "1 day"
) -> StreamingQuery:
    """Write every window whenever it changes, the open ones included; a repeated batch replaces its rows."""

    def land(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        (
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id").parquet(log)
        )

    return (
        activity(messages.withWatermark("create_time", lateness), length)
        .writeStream.outputMode("update").foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_activity(log: DataFrame) -> DataFrame:
    """The latest count of each window and chatroom."""
    return log.groupBy("window_start", "window_end", "chatroom").agg(F.max_by("messages", "batch_id").alias("messages"))


def stream_activity(
    messages: DataFrame, out: str, checkpoint: str, length: str = "1 hour", lateness: str = "1 day"
) -> StreamingQuery:
    """Append finished windows as Parquet once the watermark has passed them."""
    return (
        activity(messages.withWatermark("create_time", lateness), length)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
