"""Overdue accounts: worklists, stage roll-ups, risk bands, plans and e-mails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions import exprs as x
from ledgerlane.operators import prompts as p
from ledgerlane.operators import reports as r
from ledgerlane.plans.registry import query
from ledgerlane.sources import dims, sinks
from ledgerlane.sources.schemas import DOMAINS, PAYMENT_PLAN
from ledgerlane.sources.views import AS_OF, Lending, cents

STAGES = DOMAINS["collections"]["collection_stage"]


def stage_report(book: Lending) -> DataFrame:
    """The worklist joined to its customers, banded, and rolled up by stage and band."""
    return (
        r.with_customer(book.collections, book.customers)
        .withColumns({"risk_score": x.overdue_risk(), "band": x.risk_band()})
        .groupBy("collection_stage", "band")
        .agg(
            F.count(F.lit(1)).alias("accounts"),
            r.total_money("outstanding_amount").alias("outstanding"),
            F.max("risk_score").alias("worst_risk"),
        )
    )


@query
def collections_worklist(book: Lending) -> DataFrame:
    return (
        r.with_customer(book.collections, book.customers)
        .select(
            "id", "customer", "email", "outstanding_amount", "days_overdue", "collection_stage", "loan_id"
        )
        .orderBy(F.desc_nulls_last("days_overdue"), F.desc("id"))
    )


@query
def collections_filtered(book: Lending) -> DataFrame:
    chosen = r.in_sets(book.collections, {"collection_stage": ["mid", "late"]}).where(
        (F.col("outstanding_amount") >= 100000) & (F.col("days_overdue") >= 45)
    )
    return r.with_customer(chosen, book.customers).select(
        "id",
        "customer",
        "loan_id",
        "outstanding_amount",
        x.money_text("outstanding_amount").alias("outstanding_text"),
        "days_overdue",
        "collection_stage",
        x.risk_band().alias("band"),
    )


@query
def high_risk_accounts(book: Lending) -> DataFrame:
    return r.with_customer(book.collections.where("days_overdue > 60"), book.customers).select(
        "id", "customer", "loan_id", "outstanding_amount", "days_overdue"
    )


@query
def collections_by_stage(book: Lending) -> DataFrame:
    return book.collections.groupBy("collection_stage").agg(
        F.count(F.lit(1)).alias("n"), r.mean_money("outstanding_amount").alias("avg_outstanding")
    )


@query
def collections_totals(book: Lending) -> DataFrame:
    sums = {
        "owed": F.sum(cents("outstanding_amount")),
        "days": F.sum("days_overdue"),
        "dated": F.count("days_overdue"),
        "accounts": F.count(F.lit(1)),
        "high_risk": F.count_if(F.col("days_overdue") > 60),
    }
    return r.owned_sums(book.collections, book.customers, sums).select(
        (F.col("owed").cast("double") / 100).alias("total_outstanding"),
        F.try_divide(F.col("days").cast("double"), F.col("dated")).alias("avg_days_overdue"),
        F.coalesce("accounts", F.lit(0)).alias("accounts"),
        F.coalesce("high_risk", F.lit(0)).alias("high_risk"),
    )


@query
def stage_value_counts(book: Lending) -> DataFrame:
    staged = book.collections.where(F.col("collection_stage").isNotNull())
    counted = r.owned_sums(staged, book.customers, {"n": F.count(F.lit(1))}, ("collection_stage",))
    return counted.orderBy(F.desc("n"), "collection_stage")


@query
def outstanding_by_stage(book: Lending) -> DataFrame:
    staged = book.collections.where(F.col("collection_stage").isNotNull())
    sums = {"owed": F.sum(cents("outstanding_amount"))}
    return r.owned_sums(staged, book.customers, sums, ("collection_stage",)).select(
        "collection_stage", (F.col("owed").cast("double") / 100).alias("outstanding")
    )


@query
def stage_counts_zero_filled(book: Lending) -> DataFrame:
    sums = r.counters("collection_stage", STAGES)
    return r.as_rows(r.owned_sums(book.collections, book.customers, sums), "collection_stage", STAGES)


@query
def overdue_heatmap(book: Lending) -> DataFrame:
    return r.overdue_grid(book.collections, book.customers, days=30, amount=1000)


@query
def overdue_bands(book: Lending) -> DataFrame:
    return book.collections.select(
        "id",
        "days_overdue",
        "collection_stage",
        x.seed_stage().alias("seed_stage"),
        x.workflow_stage().alias("workflow_stage"),
        x.risk_band().alias("band"),
    )


@query
def stage_actions(book: Lending) -> DataFrame:
    names = {s: name for s, (name, _) in dims.STAGE_ACTIONS.items()}
    steps = F
    for stage, (_, actions) in dims.STAGE_ACTIONS.items():
        steps = steps.when(F.col("collection_stage") == stage, F.array(*map(F.lit, actions)))
    return book.collections.select(
        "id",
        "collection_stage",
        x.lookup("collection_stage", names).alias("stage_name"),
        F.posexplode(steps).alias("at", "action"),
    ).select("id", "collection_stage", "stage_name", (F.col("at") + 1).alias("step"), "action")


@query
def payment_plans(book: Lending) -> DataFrame:
    planned = book.collections.withColumn("next_action_date", x.next_action_date()).withColumn(
        "plan", x.payment_plan(start="next_action_date")
    )
    stored = planned.withColumn("payment_plan", F.to_json("plan"))
    return stored.withColumn("p", x.parse_json("payment_plan", PAYMENT_PLAN)).select(
        "id",
        x.padded_id("LOAN", "id").alias("loan_number"),
        "next_action_date",
        F.col("p.monthly_payment").alias("monthly_payment"),
        F.col("p.duration_months").alias("duration_months"),
        F.col("p.interest_rate").alias("interest_rate"),
        F.col("p.start_date").alias("start_date"),
    )


@query
def apply_email_updates(book: Lending) -> DataFrame:
    base = book.collections.select("id", "days_overdue").withColumns(
        {
            "ai_generated_email": F.when(F.col("days_overdue") > 60, F.concat(F.lit("Saved e-mail for "), "id")),
            "updated_at": F.lit("2001-01-01").cast("date"),
        }
    )
    # Each account sends two versions; the second has no content where the account is early,
    # and every business partner also writes to an id that does not exist.
    versions = F.explode(F.array(F.lit(1), F.lit(2)))
    updates = book.collections.select("id", "collection_stage", versions.alias("version")).select(
        F.when(F.col("collection_stage") == "legal", -F.col("id") - 1).otherwise(F.col("id")).alias("id"),
        "version",
        F.when(
            (F.col("version") == 1) | (F.col("collection_stage") != "early"),
            F.concat(F.lit("Version "), "version", F.lit(" for stage "), "collection_stage"),
        ).alias("email_content"),
    )
    return sinks.apply_email_updates(base, updates, F.lit(AS_OF).cast("date"))


@query
def collection_email_prompts(book: Lending) -> DataFrame:
    tone = (
        F.when(F.col("days_overdue") <= 30, "Friendly")
        .when(F.col("days_overdue") <= 60, "Professional")
        .when(F.col("days_overdue") <= 90, "Firm")
        .otherwise("Urgent")
    )
    accounts = r.with_customer(book.collections, book.customers).withColumns(
        {"tone": tone, "offer_plan": F.col("collection_stage") != "legal"}
    )
    return p.collection_emails(accounts)
