"""Customer service: figures, sentiment, recent contacts, prompts and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions import exprs as x
from ledgerlane.functions import text as tx
from ledgerlane.operators import customer360 as c360
from ledgerlane.operators import prompts as p
from ledgerlane.operators import reports as r
from ledgerlane.plans.registry import query
from ledgerlane.sources.views import Lending


@query
def service_kpis(book: Lending) -> DataFrame:
    """Totals of all interactions. Sentiment is averaged exactly over scores rounded to six decimals."""
    total, resolved = F.col("total_interactions"), F.col("resolved")
    return book.service.agg(
        F.count(F.lit(1)).alias("total_interactions"),
        F.try_divide(
            F.sum(F.col("sentiment_score").cast("decimal(18,6)")).cast("double"), F.count("sentiment_score")
        ).alias("avg_sentiment"),
        F.count_if(F.col("resolution_status") == "resolved").alias("resolved"),
        F.count_distinct("customer_id").alias("unique_customers"),
    ).withColumn("resolution_rate", F.when(total > 0, resolved / total * 100.0).otherwise(F.lit(0.0)))


@query
def sentiment_distribution(book: Lending) -> DataFrame:
    scored = book.service.where(F.col("sentiment_score").isNotNull())
    return scored.groupBy(x.sentiment_category().alias("sentiment_category")).agg(F.count(F.lit(1)).alias("n"))


@query
def recent_interactions_5(book: Lending) -> DataFrame:
    return r.latest_with_customer(book.service, book.customers, 5).select(
        "id", "customer", "subject", "sentiment_score", x.sentiment_alert().alias("alert")
    )


@query
def recent_interactions_10(book: Lending) -> DataFrame:
    return r.latest_with_customer(book.service, book.customers, 10).select(
        "id",
        "customer",
        "subject",
        "sentiment_score",
        x.sentiment_category().alias("sentiment_category"),
        "resolution_status",
        "created_at",
    )


@query
def sentiment_flags(book: Lending) -> DataFrame:
    return book.service.select(
        "id",
        "sentiment_score",
        x.sentiment_category().alias("sentiment_category"),
        x.sentiment_alert().alias("alert"),
        x.needs_escalation().alias("escalate"),
    )


@query
def escalations(book: Lending) -> DataFrame:
    return book.service.where(x.needs_escalation(threshold=-0.7)).select(
        "id", "customer_id", "subject", "sentiment_score", "priority"
    )


@query
def canned_answers(book: Lending) -> DataFrame:
    return p.canned_answers(book.service).select("id", "subject", "issue", "answer")


@query
def parsed_sentiment(book: Lending) -> DataFrame:
    score, subject = F.col("sentiment_score").cast("string"), F.col("subject")
    whole = F.concat(F.lit('{"score": '), score, F.lit(', "explanation": "'), subject, F.lit('"}'))
    reply = (
        F.when(F.col("priority") == "low", F.concat(F.lit("The feeling is "), score))
        .when(F.col("priority") == "high", F.concat(F.lit('{"explanation": "'), subject, F.lit('"}')))
        .when(F.col("priority") == "urgent", F.concat(F.lit('{"score": '), score, F.lit(', "explanation": "cut')))
        .otherwise(whole)
    )
    return book.service.select("id", tx.parse_sentiment(reply).alias("s")).select("id", "s.score", "s.explanation")


@query
def service_prompts(book: Lending) -> DataFrame:
    """Prompts with the profile as context; all verification records are in ``customer_360_verifications``."""
    profiles = c360.customer_360(book.states, book.kyc)
    said = F.coalesce("message", "subject") if "message" in book.service.columns else F.col("subject")
    return p.service_replies(book.service.select("id", "customer_id", said.alias("message")), profiles)


@query
def service_contexts(book: Lending) -> DataFrame:
    """The whole context of a reply per customer, every verification record in it, in numbered pieces."""
    return c360.service_contexts(book.states, book.kyc)
