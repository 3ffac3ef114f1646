"""Streams and appends run end to end on given rows: what arrives in pieces ends as the tables that SQL gives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.plans.registry import query
from ledgerlane.sources import sinks
from ledgerlane.sources.files import scratch_folder
from ledgerlane.sources.views import AS_OF, Lending
from ledgerlane.streaming import interactions as chat

DELAY = "10 minutes"


def messages(book: Lending) -> DataFrame:
    """The interactions as chat messages with the reply of a sentiment model."""
    score = F.col("sentiment_score").cast("string")
    reply = F.concat(F.lit('{"score": '), score, F.lit(', "explanation": ""}'))
    return book.service.select(
        "id",
        "customer_id",
        F.col("subject").alias("message"),
        F.lit("ok").alias("ai_response"),
        F.coalesce(reply, F.lit("no reply")).alias("sentiment_reply"),
        F.col("created_at").cast("timestamp").alias("created_at"),
    )


@query
def streamed_interactions(book: Lending) -> DataFrame:
    """The service table after a stream of messages that come late, come again, and are replayed.

    Three arrivals hold the messages by id, each with a tenth of the one before once more; they are
    read in three runs. Then the last batch is run again, as after a failure before its commit.
    """
    folder = scratch_folder(book.spark, "messages")
    source, table, mark = f"{folder}/in", f"{folder}/table", f"{folder}/mark"
    rows = messages(book)
    arrival = F.pmod("id", F.lit(3))
    for n in range(3):
        again = (arrival == n - 1) & (F.col("id") % 10 == 0)
        rows.where((arrival == n) | again).write.mode("append").parquet(source)
        stream = chat.as_interactions(chat.flagged(chat.read_messages(book.spark, source)))
        chat.store_messages(stream, table, mark).awaitTermination()
    replayed = rows.where((arrival == 2) | ((arrival == 1) & (F.col("id") % 10 == 0)))
    chat.append_batch(chat.as_interactions(chat.flagged(replayed)), 2, table)
    stored = book.spark.read.parquet(table)
    return stored.select(
        "id", "customer_id", "interaction_type", "message", "sentiment_score", "resolution_status",
        F.col("batch").cast("long").alias("batch"),
    )


@query
def alert_windows(book: Lending) -> DataFrame:
    """Messages per closed hour and sentiment, from a stream with a watermark.

    Four arrivals hold a quarter of the time each, a twentieth of their messages twice. Every fiftieth
    message of the first three quarters comes with the last arrival only; by then the watermark has
    passed it, so it no longer counts.
    """
    folder = scratch_folder(book.spark, "alerts")
    source, table, mark = f"{folder}/in", f"{folder}/table", f"{folder}/mark"
    rows = messages(book)
    first, last = rows.agg(F.min(F.unix_micros("created_at")), F.max(F.unix_micros("created_at"))).first()
    if first is None:
        first = last = 0
    width = (last - first) // 4 + 1
    quarter = F.floor((F.unix_micros("created_at") - F.lit(first)) / F.lit(width))
    late = F.pmod("id", F.lit(50)) == 7
    arrival = F.when(late, 3).otherwise(quarter)
    for n in range(4):
        new = rows.where(arrival == n)
        new.union(new.where(F.pmod("id", F.lit(20)) == 3)).write.mode("append").parquet(source)
        counts = chat.alert_counts(chat.flagged(chat.read_messages(book.spark, source)), "1 hour", DELAY)
        chat.append_to(counts, table, mark).awaitTermination()
    return book.spark.read.schema(
        "window_start timestamp, sentiment_category string, n long, n_escalated long"
    ).parquet(table)


@query
def append_ids(book: Lending) -> DataFrame:
    """Two appends without ids to one stored table: numbers go on from the stored ones, without gaps."""
    path = f"{scratch_folder(book.spark, 'appended')}/customer_service"
    now = F.lit(AS_OF).cast("timestamp_ntz")
    first = book.service.where("id % 2 = 0").drop("id").withColumn("message", F.lit("load 1"))
    chats = book.service.where("id % 2 <> 0").select(
        "customer_id", F.lit("load 2").alias("message"), F.lit("ok").alias("ai_response"), "sentiment_score"
    )
    for rows in (first, sinks.chat_interactions(chats)):
        sinks.append_rows(rows, "customer_service", path, now)
    return (
        book.spark.read.parquet(path)
        .groupBy(F.col("message").alias("load"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"),
            F.min("id").alias("first_id"), F.max("id").alias("last_id"),
            F.count_if(F.col("resolution_status") == "resolved").alias("n_resolved"),
        )
    )


@query
def append_unique(book: Lending) -> DataFrame:
    """Customers in two appends, then two loads that repeat an e-mail and an id: refused, the table as it was."""
    path = f"{scratch_folder(book.spark, 'unique')}/customers"
    now = F.lit(AS_OF).cast("timestamp_ntz")
    rows = book.customers
    for part in (rows.where("id % 2 = 0"), rows.where("id % 2 <> 0")):
        sinks.append_rows(part, "customers", path, now)
    repeats = {
        "e-mail": rows.withColumn("id", -F.col("id") - 1),
        "id": rows.withColumn("email", F.concat(F.lit("new."), "email")),
    }
    refused = []
    for name, load in repeats.items():
        try:
            sinks.append_rows(load, "customers", path, now)
        except ValueError:
            refused.append(name)
    held = book.spark.read.parquet(path)
    return reduce(
        DataFrame.unionByName,
        [
            held.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("email").alias("n_emails")).select(
                F.lit(name).alias("repeated"), F.lit(name in refused).alias("refused"), "n_rows", "n_emails"
            )
            for name in repeats
        ],
    )
