"""The support-chat path as a stream: score replies, flag them, append, and count alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlane.functions import exprs as x
from ledgerlane.functions import text as tx
from ledgerlane.sources.schemas import conform
from ledgerlane.sources.files import stored_rows

# What arrives: one file row per answered message, with the sentiment reply as text.
MESSAGE_SCHEMA = (
    "id bigint, customer_id bigint, message string, ai_response string, sentiment_reply string, created_at timestamp"
)


def read_messages(spark: SparkSession, path: str, files_per_batch: int = 1 << 30) -> DataFrame:
    """All files that have come below a path. What has come by the start of a run is one batch, unless limited."""
    return (
        spark.readStream.schema(MESSAGE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def flagged(messages: DataFrame) -> DataFrame:
    """Messages with parsed sentiment, alert and escalation flag. No message is dropped, however late."""
    return (
        messages.withColumn("sentiment", tx.parse_sentiment(F.col("sentiment_reply")))
        .withColumn("sentiment_score", F.col("sentiment.score"))
        .withColumns({"alert": x.sentiment_alert(), "escalate": x.needs_escalation()})
        .drop("sentiment", "sentiment_reply")
    )


def as_interactions(messages: DataFrame) -> DataFrame:
    """Rows of the service table for the messages of known customers."""
    kept = messages.where(F.col("customer_id").isNotNull()).withColumns(
        {
            "interaction_type": F.lit("chat"),
            "subject": F.lit("General Inquiry"),
            "resolution_status": F.lit("resolved"),
            "priority": F.lit("medium"),
        }
    )
    return conform(kept, "customer_service")


def alert_counts(messages: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Messages per window and sentiment category; a window is emitted once it is closed.

    The watermark frees the state: repeats of an id within it count once, and a message
    older than it no longer changes a closed window.
    """
    once = messages.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"])
    return (
        once.groupBy(F.window("created_at", window).alias("w"), x.sentiment_category().alias("sentiment_category"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("escalate").alias("n_escalated"))
        .select(F.col("w.start").alias("window_start"), "sentiment_category", "n", "n_escalated")
    )


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all that has arrived, exactly once, through the file sink's own commit log."""
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def append_batch(batch: DataFrame, number: int, path: str) -> None:
    """Write one batch as its own partition, without the messages that earlier batches hold.

    The partition is replaced as a whole, so a batch that is run again after a failure, with the
    same rows and the same number, leaves the table as it was. A repeated message carries the date
    of the first, so only the stored days of the batch are compared.
    """
    spark, columns = batch.sparkSession, batch.columns
    batch = batch.where("id IS NOT NULL").dropDuplicates(["id"])
    held = stored_rows(spark, path, batch.withColumn("batch", F.lit(0).cast("long")).schema)
    if held is not None:
        day = F.col("created_at").cast("date")
        low, high = batch.agg(F.min(day), F.date_add(F.max(day), 1)).first()
        near = F.col("created_at").between(F.lit(low), F.lit(high)) | F.col("created_at").isNull()
        earlier = held.where((F.col("batch") < number) & near).select("id")
        batch = batch.join(earlier, "id", "left_anti").select(*columns)
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def store_messages(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add every arrived message to the service table once, late ones as well."""
    return (
        stream.writeStream.foreachBatch(lambda batch, number: append_batch(batch, number, path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
