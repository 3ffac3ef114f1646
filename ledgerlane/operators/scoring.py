"""Credit features and scoring by a linear scorecard, with explanations per feature."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions import exprs as x

# Feature order of the model.
FEATURES = [
    "age",
    "is_business",
    "monthly_income",
    "monthly_expenses",
    "current_balance",
    "expense_to_income_ratio",
    "savings_rate",
    "overdrafts",
    "returned_payments",
    "gambling_transactions",
    "irregular_income",
    "existing_credit_score",
    "country_risk",
]


@dataclass(frozen=True)
class Weight:
    feature: str
    coefficient: float
    mean: float
    std: float


@dataclass(frozen=True)
class Scorecard:
    intercept: float
    weights: tuple[Weight, ...]


# Pinned scorecard for repeatable scoring; means and deviations are round numbers
# near those of the lending views.
PINNED = Scorecard(
    intercept=0.85,
    weights=(
        Weight("age", 0.12, 32.0, 11.5),
        Weight("is_business", -0.05, 0.4, 0.49),
        Weight("monthly_income", 0.18, 230000.0, 150000.0),
        Weight("monthly_expenses", -0.14, 190000.0, 120000.0),
        Weight("current_balance", 0.21, 4500.0, 3200.0),
        Weight("expense_to_income_ratio", -0.46, 0.78, 0.18),
        Weight("savings_rate", 0.39, 0.24, 0.18),
        Weight("overdrafts", -0.27, 0.2, 0.42),
        Weight("returned_payments", -0.33, 0.35, 0.5),
        Weight("gambling_transactions", -0.24, 0.1, 0.3),
        Weight("irregular_income", -0.17, 0.27, 0.44),
        Weight("existing_credit_score", 0.52, 600.0, 140.0),
        Weight("country_risk", -0.11, 0.18, 0.08),
    ),
)


def credit_profiles(states: DataFrame) -> DataFrame:
    """What the features need from customers with their states; customers without children stay."""
    held = [F.col(f"statement_held.{c}").alias(c) for c in ("monthly_income", "monthly_expenses", "balance", "risk_indicators")]
    score = [F.col("score_held.score").alias("score"), F.col("score_held").isNotNull().alias("has_score")]
    return states.select("*", *score, *held).drop("score_held", "statement_held")


def credit_features(
    profiles: DataFrame, as_of: str, reference_defaults: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """The thirteen model features per customer, all double and never NULL, and the columns to ``keep``.

    ``reference_defaults`` keeps age, business flag and country at their fallback
    values instead of reading the customer.
    """
    if reference_defaults:
        age, business, country = F.lit(x.DEFAULT_AGE), F.lit(0), F.lit(x.COUNTRY_RISK["Germany"])
    else:
        age = x.age_at(as_of)
        business = F.when(F.col("customer_type") == "business", 1).otherwise(0)
        country = x.country_risk()
    filled = profiles.withColumns(
        {
            "monthly_income": F.coalesce("monthly_income", F.lit(0.0)),
            "monthly_expenses": F.coalesce("monthly_expenses", F.lit(0.0)),
            "flags": x.parse_indicators("risk_indicators"),
        }
    )
    values = {
        "age": age,
        "is_business": business,
        "monthly_income": F.col("monthly_income"),
        "monthly_expenses": F.col("monthly_expenses"),
        "current_balance": F.coalesce("balance", F.lit(0.0)),
        "expense_to_income_ratio": x.expense_ratio(),
        "savings_rate": x.savings_rate(),
        "overdrafts": F.col("flags.overdrafts"),
        "returned_payments": F.col("flags.returned_payments"),
        "gambling_transactions": F.col("flags.gambling_transactions"),
        "irregular_income": F.col("flags.irregular_income"),
        "existing_credit_score": F.coalesce("score", F.lit(x.DEFAULT_SCORE)),
        "country_risk": country,
    }
    return filled.select(
        "customer_id",
        x.display_name().alias("customer"),
        "email",
        *[values[f].cast("double").alias(f) for f in FEATURES],
        *keep,
    )


def lending_features(
    lending, as_of: str, reference_defaults: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """Features of every customer from one pass over the lending tables."""
    return credit_features(credit_profiles(lending.states), as_of, reference_defaults, keep)


def _standardised(w: Weight) -> Column:
    return (F.col(w.feature) - F.lit(w.mean)) / F.lit(w.std)


def log_odds(card: Scorecard) -> Column:
    return reduce(add, [F.lit(w.coefficient) * _standardised(w) for w in card.weights], F.lit(card.intercept))


def to_score(probability: Column) -> Column:
    """Probability of good credit on the 300..850 scale, halves to even."""
    return x.half_even(F.lit(300.0) + probability * F.lit(550.0)).cast("int")


def with_score(df: DataFrame, probability: Column) -> DataFrame:
    scored = df.withColumn("probability", probability).withColumn("credit_score", to_score(F.col("probability")))
    return scored.withColumn("risk_level", x.score_risk_level("credit_score"))


def score_by_card(features: DataFrame, card: Scorecard = PINNED) -> DataFrame:
    """Scores as plain column arithmetic: the scan's own stage, nothing moves."""
    return with_score(features, F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds(card))))


def contribution_array(card: Scorecard = PINNED) -> Column:
    """Per-feature impacts of one row, the largest absolute raw impact first."""
    entries = []
    for w in card.weights:
        raw = F.lit(w.coefficient) * F.col(w.feature)
        entries.append(
            F.struct(
                (-F.abs(raw)).alias("sort_key"),
                F.lit(w.feature).alias("feature"),
                F.col(w.feature).alias("value"),
                F.lit(w.coefficient).alias("coefficient"),
                raw.alias("impact_raw"),
                (F.lit(w.coefficient) * _standardised(w)).alias("impact_scaled"),
                F.lit("Positive" if w.coefficient > 0 else "Negative").alias("effect"),
            )
        )
    return F.array_sort(F.array(*entries))


def feature_contributions(features: DataFrame, card: Scorecard = PINNED, top: int | None = None) -> DataFrame:
    """One row per customer and feature, ranked; ``top`` keeps the first few per customer.

    The ranking sorts thirteen entries inside the row, so there is no window.
    """
    ranked = contribution_array(card)
    if top is not None:
        ranked = F.slice(ranked, 1, top)
    return features.select("customer_id", F.posexplode(ranked).alias("at", "c")).select(
        "customer_id",
        (F.col("at") + 1).alias("impact_rank"),
        x.title_case("c.feature").alias("feature"),
        "c.value",
        "c.coefficient",
        "c.impact_raw",
        "c.impact_scaled",
        "c.effect",
    )


def feature_statistics(features: DataFrame) -> DataFrame:
    """Mean and population deviation of every feature, from one pass.

    Values count in millionths as whole numbers, so the sums are exact and the order of rows cannot move them.
    """
    n = F.count(F.lit(1))

    def measured(f: str) -> Column:
        value = F.rint(F.col(f) * 1e6).cast("decimal(18,0)")
        mean = F.sum(value).cast("double") / n
        spread = F.sum(value * value).cast("double") / n - mean * mean
        return F.struct((mean / 1e6).alias("mean"), (F.sqrt(F.greatest(spread, F.lit(0.0))) / 1e6).alias("std")).alias(f)

    row = features.agg(*[measured(f) for f in FEATURES])
    return row.unpivot([], FEATURES, "feature", "s").select("feature", "s.mean", "s.std")


def model_insights(features: DataFrame, card: Scorecard = PINNED, top: int = 10) -> DataFrame:
    """The strongest coefficients, beside the spread of their features over all customers."""
    weights = {w.feature: w.coefficient for w in card.weights}
    coefficient = x.lookup("feature", weights)
    return (
        feature_statistics(features)
        .withColumn("coefficient", coefficient)
        .select(
            x.title_case("feature").alias("feature"),
            "coefficient",
            F.abs("coefficient").alias("importance"),
            F.when(F.col("coefficient") > 0, "Positive").otherwise("Negative").alias("effect"),
            "mean",
            "std",
        )
        .orderBy(F.desc("importance"), "feature")
        .limit(top)
    )
