"""Audits of the declared constraints, and defaults on ingest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.operators import quality as q
from ledgerlane.plans.registry import query
from ledgerlane.sources.schemas import CHILD_TABLES, DOMAINS, REQUIRED, SCORE_RANGE
from ledgerlane.sources.views import AS_OF, Lending


def _audited(book: Lending) -> dict[str, DataFrame]:
    """The tables to audit, in their form before any row is refused."""
    return {t: book.view(f"{t}_raw") for t in DOMAINS}


@query
def dq_enum_domain(book: Lending) -> DataFrame:
    frames = [q.enum_violations(df, t, DOMAINS[t]) for t, df in _audited(book).items()]
    return reduce(DataFrame.unionByName, frames)


@query
def dq_not_null(book: Lending) -> DataFrame:
    frames = [q.null_violations(df, t, REQUIRED[t]) for t, df in _audited(book).items() if t in REQUIRED]
    return reduce(DataFrame.unionByName, frames)


@query
def dq_score_range(book: Lending) -> DataFrame:
    return q.range_violations(book.view("credit_scores_raw"), "score", *SCORE_RANGE)


@query
def dq_unique_email(book: Lending) -> DataFrame:
    return q.duplicate_values(book.view("customers_raw"), "email")


@query
def dq_fk_orphans(book: Lending) -> DataFrame:
    children = {t: book.statement_facts if t == "bank_statements" else book.view(f"{t}_raw") for t in CHILD_TABLES}
    return q.orphan_keys(children, book.customers)


@query
def ingest_defaults(book: Lending) -> DataFrame:
    """Feeds without their status columns get the defaults; a NULL status in the feed stays."""
    now = F.lit(AS_OF).cast("timestamp_ntz")
    feeds = {
        "kyc_kyb_data": (book.kyc.drop("verification_status", "created_at"), ["verification_status"]),
        "marketing_campaigns": (book.view("marketing_campaigns_raw"), ["status"]),
        "customer_service": (book.service.drop("resolution_status", "priority"), ["resolution_status", "priority"]),
        "collections": (book.collections.drop("collection_stage"), ["collection_stage"]),
    }
    filled = [
        q.apply_defaults(feed, t, now)
        .select(*columns, F.col("created_at").cast("date").alias("day"))
        .unpivot(["day"], columns, "column_name", "value")
        .select(F.lit(t).alias("table_name"), "column_name", "value", (F.col("day") == AS_OF).alias("stamped"))
        for t, (feed, columns) in feeds.items()
    ]
    return (
        reduce(DataFrame.unionByName, filled)
        .groupBy("table_name", "column_name", "value", "stamped")
        .agg(F.count(F.lit(1)).alias("n"))
    )
