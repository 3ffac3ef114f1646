"""Credit: scores, statements, the customer profile, features, scoring and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions import exprs as x
from ledgerlane.operators import customer360 as c360
from ledgerlane.operators import logistic, ranks
from ledgerlane.operators import reports as r
from ledgerlane.operators import scoring as s
from ledgerlane.operators import training as t
from ledgerlane.plans.registry import query
from ledgerlane.session import ensure_checkpoint_dir
from ledgerlane.sources.schemas import FACTORS, SCORE_RANGE, STATEMENT_DATA
from ledgerlane.sources.views import AS_OF, Lending

# Fixed value: a bureau score counts as good from here on.
GOOD_SCORE = 670


def six(*columns: str) -> dict:
    """Columns that went through exp, ln, cos or a mean, rounded for display."""
    return {c: F.round(c, 6) for c in columns}


@query
def score_history(book: Lending) -> DataFrame:
    return (
        r.with_customer(book.score_facts, book.score_owners)
        .select("id", "customer", "score", "score_date")
        .orderBy(F.desc_nulls_last("score_date"), F.desc("id"))
    )


# What a stored score says about its reasons.
HISTORIES = ["excellent", "good", "fair"]
MIXES = ["diverse", "limited", "moderate"]


@query
def score_factors(book: Lending) -> DataFrame:
    """The reasons of every score as the JSON text that is stored, and as they read back from it."""
    at = F.pmod("id", F.lit(3)).cast("int")
    written = x.json_text(
        FACTORS,
        payment_history=F.element_at(F.array(*map(F.lit, HISTORIES)), at + 1),
        credit_utilization=F.concat((F.pmod("id", F.lit(31)) + 10).cast("string"), F.lit("%")),
        length_of_credit=F.concat((F.pmod("customer_id", F.lit(11)) + 5).cast("string"), F.lit(" years")),
        credit_mix=F.element_at(F.array(*map(F.lit, MIXES)), F.pmod("customer_id", F.lit(3)).cast("int") + 1),
    )
    stored = book.credit_scores.select("id", written.alias("factors"))
    read = stored.withColumn("f", x.parse_json("factors", FACTORS))
    return read.select(
        "id", "factors", "f.payment_history", F.rtrim(F.col("f.credit_utilization"), F.lit("%")).cast("int").alias("utilization"),
        F.split_part("f.length_of_credit", F.lit(" "), F.lit(1)).cast("int").alias("years"), "f.credit_mix",
    )


@query
def latest_score(book: Lending) -> DataFrame:
    return c360.latest_score(book.score_facts, book.score_owners)


@query
def latest_statement(book: Lending) -> DataFrame:
    return c360.latest_statement(
        book.bank_statements, ["statement_date", "balance", "monthly_income", "monthly_expenses", "transaction_count"]
    )


@query
def score_risk_levels(book: Lending) -> DataFrame:
    return c360.latest_score(book.score_facts, book.score_owners).select(
        "customer_id",
        "score",
        x.score_risk_level().alias("risk_level"),
        x.score_rating().alias("rating"),
        x.score_delta().alias("delta"),
    )


@query
def customer_360_verifications(book: Lending) -> DataFrame:
    return c360.verifications(book.states, book.kyc)


@query
def customer_360(book: Lending) -> DataFrame:
    profile = c360.customer_360(book.states, book.kyc)
    return profile.select(
        "customer_id",
        x.display_name().alias("customer"),
        "customer_type",
        "country",
        "kyc_count",
        "kyc_approved",
        F.col("latest_kyc.verification_status").alias("verification_status"),
        F.col("credit_score.score").cast("double").alias("score"),
        F.col("credit_score.score_date").alias("score_date"),
        F.col("bank_statement.statement_date").alias("statement_date"),
        F.col("bank_statement.monthly_income").alias("monthly_income"),
        F.col("bank_statement.monthly_expenses").alias("monthly_expenses"),
    )


@query
def country_risk(book: Lending) -> DataFrame:
    return book.customers.select("id", "country", x.country_risk().alias("country_risk"))


@query
def statement_trends(book: Lending) -> DataFrame:
    return c360.statement_trends(book.bank_statements).withColumns(
        {
            "income_sd": F.round("income_sd", 4),
            "expense_ratio_mean": F.round("expense_ratio_mean", 6),
        }
    )


@query
def statement_risk(book: Lending) -> DataFrame:
    flags = x.parse_indicators()
    return (
        book.bank_statements.select("customer_id", "statement_date", flags.alias("flags"))
        .withColumn("risk", x.statement_risk("flags"))
        .select(
            "customer_id",
            "statement_date",
            F.col("flags.overdrafts").alias("overdrafts"),
            F.col("flags.returned_payments").alias("returned_payments"),
            F.col("flags.gambling_transactions").alias("gambling_transactions"),
            F.col("flags.irregular_income").alias("irregular_income"),
            "risk",
            x.statement_risk_class("risk").alias("risk_class"),
        )
    )


@query
def statement_transactions(book: Lending) -> DataFrame:
    parsed = F.from_json("statement_data", STATEMENT_DATA)["transactions"]
    return (
        book.bank_statements.select("customer_id", "statement_date", F.posexplode(parsed).alias("at", "t"))
        .select(
            "customer_id",
            "statement_date",
            (F.col("at") + 1).alias("line_no"),
            F.col("t.date").alias("booked_on"),
            F.col("t.description").alias("description"),
            F.col("t.amount").alias("amount"),
        )
    )


@query
def income_allocation(book: Lending) -> DataFrame:
    return c360.income_allocation(c360.latest_statement(book.bank_statements, ["statement_date", "monthly_income", "monthly_expenses"]))


# features and scores ----------------------------------------------------------


@query
def credit_features(book: Lending) -> DataFrame:
    return s.lending_features(book, AS_OF).drop("customer", "email")


@query
def credit_features_fallback(book: Lending) -> DataFrame:
    """Features with age, business flag and country at their fallback values."""
    return s.lending_features(book, AS_OF, reference_defaults=True).drop("customer", "email")


def card_scores(book: Lending) -> DataFrame:
    return s.score_by_card(s.lending_features(book, AS_OF))


@query
def scorecard_scores(book: Lending) -> DataFrame:
    return (
        card_scores(book)
        .select("customer_id", "customer", "email", "probability", "credit_score", "risk_level")
        .withColumns(six("probability"))
    )


@query
def feature_contributions(book: Lending) -> DataFrame:
    return s.feature_contributions(s.lending_features(book, AS_OF))


@query
def top_feature_impacts(book: Lending) -> DataFrame:
    return s.feature_contributions(s.lending_features(book, AS_OF), top=8).select(
        "customer_id",
        "impact_rank",
        "feature",
        x.half_even("value", 3).alias("value"),
        x.half_even("impact_raw", 3).alias("impact"),
        "effect",
    )


@query
def model_feature_insights(book: Lending) -> DataFrame:
    return s.model_insights(s.lending_features(book, AS_OF)).withColumns(
        {"mean": F.round("mean", 4), "std": F.round("std", 4)}
    )


@query
def score_summary(book: Lending) -> DataFrame:
    level = F.col("risk_level")
    return card_scores(book).agg(
        F.avg("credit_score").alias("avg_score"),
        F.count_if(level == "High Risk").alias("high_risk"),
        F.count_if(level == "Low Risk").alias("low_risk"),
        F.count(F.lit(1)).alias("total_scored"),
    )


@query
def risk_level_distribution(book: Lending) -> DataFrame:
    return r.counts(card_scores(book), "risk_level")


@query
def score_histogram(book: Lending) -> DataFrame:
    """Scores of the batch run and of the bureau history, in twenty equal bins each."""
    low, high = SCORE_RANGE
    batch = r.value_histogram(card_scores(book), "credit_score", low, high, 20)
    bureau = r.value_histogram(book.score_facts, "score", low, high, 20, book.score_owners)
    return batch.withColumn("source", F.lit("batch")).unionByName(bureau.withColumn("source", F.lit("bureau")))


def labelled(features: DataFrame) -> DataFrame:
    """Features of customers with a bureau score, labelled good from 670 on."""
    return features.withColumn(t.LABEL, F.when(F.col("existing_credit_score") >= GOOD_SCORE, 1).otherwise(0))


def labelled_customers(book: Lending) -> DataFrame:
    states = book.states.where(F.col("score_held").isNotNull())
    return labelled(s.credit_features(s.credit_profiles(states), AS_OF))


@query
def training_data(book: Lending) -> DataFrame:
    """The labelled rows a model is fitted on: features from the tables, label from the bureau."""
    return labelled_customers(book).select("customer_id", *s.FEATURES, t.LABEL).withColumns(six(*s.FEATURES))


@query
def label_probability(book: Lending) -> DataFrame:
    """The label rule on the real features of every customer."""
    return s.lending_features(book, AS_OF).select(
        "customer_id", F.round(t.label_probability(), 6).alias("good_credit_probability")
    )


def rated_customers(book: Lending) -> DataFrame:
    """Label and scorecard score of every customer with a bureau score."""
    return s.score_by_card(labelled_customers(book)).select(t.LABEL, "credit_score")


@query
def classification_report(book: Lending) -> DataFrame:
    """How well the pinned scorecard tells customers with a good bureau score from the others."""
    good = F.when(F.col("credit_score") >= GOOD_SCORE, 1).otherwise(0)
    return t.classification_report(rated_customers(book).withColumn("prediction", good), t.LABEL, "prediction")


@query
def model_auc(book: Lending) -> DataFrame:
    """Area under the curve of the pinned scorecard, exact: scores are whole numbers, counted per score."""
    return t.exact_auc(rated_customers(book), t.LABEL, "credit_score")


@query
def split_counts(book: Lending) -> DataFrame:
    """Labelled customers that train and that test, per label: four fifths of each, rounded down, train."""
    ensure_checkpoint_dir(book.spark)
    rows = labelled_customers(book).select("customer_id", t.LABEL).checkpoint()
    chosen = ranks.in_share(rows, "customer_id", t.LABEL, t.TRAINING_SHARE)
    return rows.groupBy(t.LABEL).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(chosen).alias("n_train"), F.count_if(~chosen).alias("n_test")
    )


@query
def probability_auc(book: Lending) -> DataFrame:
    """Area under the curve of the pinned scorecard's probabilities, exact, by ranges of probability."""
    ensure_checkpoint_dir(book.spark)
    scored = s.score_by_card(labelled_customers(book)).select(t.LABEL, "probability").checkpoint()
    return ranks.auc_by_ranges(scored, t.LABEL, "probability")


@query
def fit_gradient(book: Lending) -> DataFrame:
    """The penalised gradient at the coefficients fitted on all labelled customers, per feature: zero at the minimum."""
    rows = labelled_customers(book)
    found = logistic.gradient(rows, t.LABEL, t.fit(rows))
    # adding zero makes a rounded -0.0 a 0.0
    return found.withColumn("gradient", F.round("gradient", 6) + F.lit(0.0))


@query
def batch_scoring(book: Lending) -> DataFrame:
    """Every customer scored by a model fitted on all labelled customers.

    The features are computed once, for the fit and the scores. The fit runs when the query is
    built; `batch_scores` with a given or stored model builds the plan alone.
    """
    ensure_checkpoint_dir(book.spark)
    fixed = s.lending_features(book, AS_OF, keep=["has_score"]).checkpoint()
    card = t.fit(labelled(fixed.where("has_score")))
    return scored_customers(fixed, card)


def batch_scores(book: Lending, model: s.Scorecard | str) -> DataFrame:
    """Every customer scored by a given model, or by the one stored at a path. Plans only; nothing runs."""
    card = t.load_model(book.spark, model) if isinstance(model, str) else model
    if card is None:
        raise ValueError(f"no model at {model}")
    return scored_customers(s.lending_features(book, AS_OF), card)


def scored_customers(features: DataFrame, card: s.Scorecard) -> DataFrame:
    return t.predict(card, features).select(
        "customer_id",
        "customer",
        "email",
        "credit_score",
        "risk_level",
        "probability",
        x.percent_text("probability").alias("probability_text"),
    )
