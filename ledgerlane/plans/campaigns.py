"""Marketing campaigns: lists, filters, drafts and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.operators import prompts as p
from ledgerlane.operators import reports as r
from ledgerlane.plans.registry import query
from ledgerlane.sources import dims, sinks
from ledgerlane.sources.views import AS_OF, Lending


@query
def campaign_list(book: Lending) -> DataFrame:
    return book.campaigns.select(
        "id", "campaign_name", "target_audience", "channel", "status", "start_date", "budget", "created_at"
    ).orderBy(*r.newest_first())


@query
def campaigns_by_status(book: Lending) -> DataFrame:
    """Campaigns per status, and a row with the total."""
    total = F.grouping("status") == 1
    return (
        book.campaigns.rollup("status")
        .agg(F.when(total, "total").otherwise(F.col("status")).alias("label"), F.count(F.lit(1)).alias("n"))
        .select(F.col("label").alias("status"), "n")
    )


@query
def campaigns_by_channel(book: Lending) -> DataFrame:
    return r.counts(book.campaigns, "channel")


@query
def campaigns_filtered(book: Lending) -> DataFrame:
    chosen = r.in_sets(
        book.campaigns,
        {"status": ["active", "draft"], "channel": ["email", "web"], "target_audience": ["ECONOMY", "SMALL", "PROMO"]},
    )
    return chosen.select(
        "id", "campaign_name", "target_audience", "channel", "status", "start_date", "budget", "created_at"
    ).orderBy(*r.newest_first())


@query
def filter_options(book: Lending) -> DataFrame:
    campaigns = r.distinct_options(book.campaigns, ["status", "channel", "target_audience"])
    return campaigns.unionByName(r.distinct_options(book.collections, ["collection_stage"]))


@query
def campaign_content_lookup(book: Lending) -> DataFrame:
    """Content of the campaigns asked for by name; names that no campaign has find nothing."""
    wanted = F.when(F.col("status") == "active", F.col("campaign_name")).otherwise(
        F.concat("target_audience", F.lit(" without a campaign"))
    )
    requests = book.campaigns.select(wanted.alias("campaign_name"))
    return r.found_in(book.campaigns, requests, "campaign_name").select("id", "campaign_name", "ai_generated_content")


@query
def campaign_drafts(book: Lending) -> DataFrame:
    requests = book.campaigns.select(
        "id", F.initcap("target_audience").alias("campaign_type"), "target_audience", "channel", "ai_generated_content"
    )
    return sinks.campaign_drafts(requests, F.lit(AS_OF).cast("date"))


def _pick(values: list[str], step: int) -> F.Column:
    """One of the values per campaign, cycling with its id."""
    return F.get(F.array(*map(F.lit, values)), (F.floor(F.col("id") / step) % len(values)).cast("int"))


def template_requests(book: Lending) -> DataFrame:
    """A template request per campaign; some name a category or an index that does not exist."""
    custom = F.when(
        F.col("status") == "active",
        F.create_map(
            F.lit("audience"), F.col("target_audience"), F.lit("tone"), F.lit("{audience}"),
            F.lit("rate"), F.col("budget").cast("decimal(18,2)").cast("string"),
        ),
    )
    return book.campaigns.select(
        F.col("id").alias("request_id"),
        _pick([*dims.TEMPLATES, "car_loans"], 1).alias("category"),
        (F.floor(F.col("id") / 6) % 3).cast("int").alias("template_index"),
        custom.alias("custom_variables"),
    )


@query
def rendered_prompts(book: Lending) -> DataFrame:
    """Prompts with the values their variables got, as name=value in order of the names."""
    rendered = p.render_prompts(template_requests(book), dims.template_table(book.spark))
    used = F.transform(F.array_sort(F.map_entries("variables_used")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rendered.withColumn("variables_used", F.array_join(used, "; "))


@query
def template_options(book: Lending) -> DataFrame:
    return p.template_options(template_requests(book), dims.template_table(book.spark))


@query
def template_combinations(book: Lending) -> DataFrame:
    return p.template_usage(template_requests(book), dims.template_table(book.spark))


@query
def missing_variables(book: Lending) -> DataFrame:
    """Custom templates filled from the campaign; drafts have no budget yet, paused ones no channel."""
    template = F.concat(
        F.lit("Promote {name} by {channel} to {audience}, {{budget}}: {budget}; again {channel}, code "), "id"
    )
    entries = F.array(
        F.struct(F.lit("name").alias("key"), F.col("campaign_name").alias("value")),
        F.struct(F.lit("audience").alias("key"), F.lower("target_audience").alias("value")),
        F.when(
            F.col("status") != "draft",
            F.struct(F.lit("budget").alias("key"), F.col("budget").cast("decimal(18,2)").cast("string").alias("value")),
        ),
        F.when(
            ~F.col("status").isin("draft", "paused"),
            F.struct(F.lit("channel").alias("key"), F.col("channel").alias("value")),
        ),
    )
    filled = p.custom_prompts(
        book.campaigns.select("id", template.alias("template"), F.map_from_entries(F.array_compact(entries)).alias("variables"))
    )
    return filled.select("id", F.array_join("missing", ",").alias("missing"), "prompt", "error")


@query
def prompt_suggestions(book: Lending) -> DataFrame:
    requests = book.campaigns.select(
        F.col("id").alias("request_id"),
        _pick(dims.LOAN_TYPES, 1).alias("loan_type"),
        _pick(dims.AUDIENCES, 5).alias("audience"),
        _pick(dims.GOALS, 30).alias("goal"),
    )
    return p.suggestions(requests)


@query
def marketing_prompts(book: Lending) -> DataFrame:
    """Every campaign's four prompts and a prompt for every statement, in one table."""
    requests = book.campaigns.select(
        F.col("id").alias("request_id"),
        F.initcap("target_audience").alias("campaign_type"),
        F.lower("target_audience").alias("target_audience"),
        "channel",
        F.when(F.col("status") == "draft", "Keep it short.").alias("instructions"),
        F.when(F.col("channel") == "email", "email campaign").otherwise("marketing copy").alias("content_type"),
        F.col("ai_generated_content").alias("prompt"),
        _pick([*dims.ENHANCEMENTS, "unheard-of"], 1).alias("enhancement_type"),
        (F.col("id") % 3 + 1).alias("n_variations"),
    )
    statements = book.bank_statements.select("customer_id", "statement_date", "statement_data", "risk_indicators")
    return p.one_prompt_table(p.campaign_prompts(requests), p.statement_prompts(statements))
