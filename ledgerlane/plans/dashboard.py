"""Dashboard and onboarding reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions import exprs as x
from ledgerlane.operators import reports as r
from ledgerlane.plans.registry import query
from ledgerlane.sources import catalog
from ledgerlane.sources.files import scratch_folder
from ledgerlane.sources.schemas import DOMAINS
from ledgerlane.sources.views import TABLES, Lending, register_views


def score_totals(book: Lending) -> DataFrame:
    """The mean score of the customers whose scores count."""
    sums = r.owned_sums(book.score_facts, book.score_owners, {"total": F.sum("score"), "n": F.count("score")})
    return sums.select(F.try_divide(F.col("total").cast("double"), F.col("n")).alias("avg_score"))


@query
def dashboard_kpis(book: Lending) -> DataFrame:
    """One row of headline figures: each table is scanned once, the one-row results are merged."""
    parts = [
        book.customers.agg(
            F.count(F.lit(1)).alias("total_customers"),
            F.count_if(F.col("customer_type") == "individual").alias("individual_customers"),
            F.count_if(F.col("customer_type") == "business").alias("business_customers"),
        ),
        book.kyc.agg(F.count_if(F.col("verification_status") == "approved").alias("approved_kyc")),
        score_totals(book),
        book.collections.agg(r.total_money("outstanding_amount").alias("total_outstanding")),
        book.campaigns.agg(F.count_if(F.col("status") == "active").alias("active_campaigns")),
    ]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


@query
def customers_by_type(book: Lending) -> DataFrame:
    return r.counts(book.customers, "customer_type")


@query
def kyc_by_status(book: Lending) -> DataFrame:
    return r.counts(book.kyc, "verification_status")


@query
def kyc_status_pivot(book: Lending) -> DataFrame:
    allowed = DOMAINS["kyc_kyb_data"]["verification_status"]
    return book.kyc.agg(*[F.count_if(F.col("verification_status") == s).alias(s) for s in allowed])


def _verifications(book: Lending, n: int) -> DataFrame:
    return r.latest_with_customer(book.kyc, book.customers, n)


@query
def recent_verifications_5(book: Lending) -> DataFrame:
    return _verifications(book, 5).select("id", "customer", "verification_status", "created_at")


@query
def recent_verifications_10(book: Lending) -> DataFrame:
    return _verifications(book, 10).select(
        "id", "customer", "verification_type", "verification_status", "risk_score", "created_at"
    )


@query
def collections_risk(book: Lending) -> DataFrame:
    return r.with_customer(book.collections, book.customers).select(
        "id",
        "customer",
        "outstanding_amount",
        "days_overdue",
        "collection_stage",
        x.overdue_risk().alias("risk_score"),
    )


@query
def customer_directory(book: Lending) -> DataFrame:
    return book.customers.select("id", x.display_name().alias("customer"), "email").withColumn(
        "label", x.directory_label(F.col("customer"))
    )


@query
def table_row_counts(book: Lending) -> DataFrame:
    return catalog.row_counts({t: book.view(t) for t in TABLES})


@query
def column_profile(book: Lending) -> DataFrame:
    return catalog.column_profiles({t: book.view(t) for t in TABLES})


@query
def adhoc_sql(book: Lending) -> DataFrame:
    register_views(book)
    return book.spark.sql("SELECT id, customer_type, email, country FROM customers WHERE country = 'Germany'")


@query
def sketched_profile(book: Lending) -> DataFrame:
    """The profile of two loads from their stored sketches, and whether each estimate is within 4 % of the exact count."""
    path = scratch_folder(book.spark, "sketches")
    tables = {t: book.view(t) for t in TABLES if t != "bank_statements"}
    for load in (0, 1):
        for name, rows in tables.items():
            part = rows.where(F.pmod("id", F.lit(2)) == load)
            catalog.profile_sketch(part, name).write.mode("append").parquet(path)
    united = catalog.united_profile(book.spark.read.parquet(path))
    exact = catalog.column_profiles(tables).select("table_name", "column_name", F.col("n_distinct").alias("exact"))
    return united.join(exact, ["table_name", "column_name"]).select(
        "table_name", "column_name", "n_rows", "n_null",
        (F.abs(F.col("n_distinct") - F.col("exact")) <= F.col("exact") * 0.04).alias("close"),
    )
