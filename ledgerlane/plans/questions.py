"""Common questions about the lending book, each as a named query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.functions import exprs as x
from ledgerlane.operators import customer360 as c360
from ledgerlane.operators import reports as r
from ledgerlane.plans.dashboard import score_totals
from ledgerlane.plans.registry import query
from ledgerlane.sources.views import Lending


def _named(customers: DataFrame) -> DataFrame:
    return customers.withColumn("customer", x.display_name())


@query
def q_total_customers(book: Lending) -> DataFrame:
    return book.customers.agg(F.count(F.lit(1)).alias("n"))


@query
def q_avg_score(book: Lending) -> DataFrame:
    return score_totals(book)


@query
def q_customers_in_collections(book: Lending) -> DataFrame:
    owing = book.collections.where("outstanding_amount > 0").select(F.col("customer_id").alias("id")).distinct()
    return _named(book.customers).join(owing, "id", "left_semi").select("id", "customer", "email")


@query
def q_pending_kyc(book: Lending) -> DataFrame:
    pending = book.kyc.where("verification_status = 'pending'").select(F.col("customer_id").alias("id")).distinct()
    return _named(book.customers).join(pending, "id", "left_semi").select("id", "customer", "email")


@query
def q_total_outstanding(book: Lending) -> DataFrame:
    return book.collections.agg(r.total_money("outstanding_amount").alias("total_outstanding"))


@query
def q_customers_germany(book: Lending) -> DataFrame:
    return _named(book.customers.where("country = 'Germany'")).select("id", "customer", "email")


@query
def q_active_campaigns(book: Lending) -> DataFrame:
    return book.campaigns.where("status = 'active'").select("id", "campaign_name", "channel", "budget")


@query
def q_common_issues(book: Lending) -> DataFrame:
    return r.counts(book.service, "subject").orderBy(F.desc("n"), "subject")


@query
def q_business_registrations(book: Lending) -> DataFrame:
    return book.customers.where("customer_type = 'business'").select("id", "company_name", "registration_number")


@query
def q_stage_distribution(book: Lending) -> DataFrame:
    everything = Window.partitionBy(F.lit(1))
    per_stage = r.counts(book.collections, "collection_stage")
    return per_stage.withColumn("share", F.col("n") / F.sum("n").over(everything))


@query
def q_scores_below_600(book: Lending) -> DataFrame:
    low = c360.latest_score(book.score_facts).where("score < 600")
    return r.with_customer(low, book.score_owners).select("customer_id", "customer", "score", "score_date")


@query
def q_avg_days_by_stage(book: Lending) -> DataFrame:
    return book.collections.groupBy("collection_stage").agg(F.avg("days_overdue").alias("avg_days_overdue"))


@query
def q_customers_by_country(book: Lending) -> DataFrame:
    return _named(book.customers).select("country", "id", "customer").orderBy("country", "id")


@query
def q_overdue_customers(book: Lending) -> DataFrame:
    return book.collections.where("days_overdue > 0").agg(F.count_distinct("customer_id").alias("n"))
