"""Training rows, the fitted model and where it is stored, evaluation, and scoring with it."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlane.functions import exprs as x
from ledgerlane.operators import logistic, ranks
from ledgerlane.operators.scoring import FEATURES, Scorecard, score_by_card
from ledgerlane.session import ensure_checkpoint_dir
from ledgerlane.sources.files import stored_rows
from ledgerlane.sources.sinks import current_path, swap_table

SEED = 42
TRAINING_ROWS = 1500
TRAINING_SHARE = Fraction(4, 5)
LABEL = "is_good_credit"

# Country weights drawn for a synthetic applicant, with probabilities.
COUNTRY_DRAWS = [(0.05, 0.1), (0.1, 0.2), (0.15, 0.2), (0.2, 0.2), (0.25, 0.2), (0.3, 0.1)]

# Starting probability of good credit, then (condition, penalty).
BASE_PROBABILITY = 0.8
PENALTIES = [
    ("expense_to_income_ratio > 0.9", 0.3),
    ("savings_rate < 0.1", 0.2),
    ("overdrafts > 2", 0.3),
    ("returned_payments > 1", 0.4),
    ("gambling_transactions = 1", 0.2),
    ("irregular_income = 1", 0.15),
    ("existing_credit_score < 600", 0.3),
    ("country_risk > 0.2", 0.1),
]


# One uniform draw per name; a normal takes two.
NORMALS = ["age", "monthly_income", "current_balance", "existing_credit_score"]
UNIFORMS = [
    "is_business",
    "business_factor",
    "expense_ratio",
    "has_overdrafts",
    "overdrafts",
    "has_returned",
    "returned_payments",
    "gambling_transactions",
    "irregular_income",
    "country_risk",
    "label",
]


DRAWS = UNIFORMS + [f"{n}/{part}" for n in NORMALS for part in ("r", "a")]


def _with_draws(ids: DataFrame, seed: int) -> DataFrame:
    """The id and its draws; one digest gives four of them."""
    blocks = range((len(DRAWS) + 3) // 4)
    hashed = ids.select("id", *[x.digest(str(seed), str(b), F.col("id")).alias(f"digest{b}") for b in blocks])
    draws = [x.unit(x.word32(f"digest{i // 4}", i % 4)).alias(f"u/{name}") for i, name in enumerate(DRAWS)]
    return hashed.select("id", *draws)


def _draw(name: str) -> Column:
    return F.col(f"`u/{name}`")


def _normal(name: str) -> Column:
    """Standard normal from two draws (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(_draw(f"{name}/r")))
    return radius * F.cos(F.lit(2.0 * math.pi) * _draw(f"{name}/a"))


def poisson_steps(rate: float, most: int = 12) -> list[float]:
    """Cumulative Poisson probabilities P(N <= 0), P(N <= 1), ...

    Draws have 32 bits: at rates up to 1 the share beyond ``most`` is below their grain.
    """
    total, term, steps = 0.0, math.exp(-rate), []
    for k in range(most):
        total += term
        steps.append(total)
        term *= rate / (k + 1)
    return steps


def _poisson(name: str, rate: float) -> Column:
    """The number of steps at or below the draw."""
    u, steps = _draw(name), poisson_steps(rate)
    counted = F.when(u < steps[0], 0)
    for k, step in enumerate(steps[1:], 1):
        counted = counted.when(u < step, k)
    return counted.otherwise(len(steps))


def _weighted_choice(name: str, weighted: list[tuple[float, float]]) -> Column:
    u, edge, chosen = _draw(name), 0.0, F
    for value, share in weighted[:-1]:
        edge = round(edge + share, 10)
        chosen = chosen.when(u < edge, value)
    return chosen.otherwise(weighted[-1][0])


def label_probability() -> Column:
    """Chance that an applicant is good credit: the base less each penalty that applies."""
    p = F.lit(BASE_PROBABILITY)
    for condition, penalty in PENALTIES:
        p = p - F.when(F.expr(condition), penalty).otherwise(0.0)
    return x.clamp(p, 0.05, 0.95)


def training_rows(ids: DataFrame, seed: int = SEED) -> DataFrame:
    """One synthetic applicant per id.

    Every draw is a function of (seed, draw, id), so rows do not depend on
    partitioning and any subset can be made again anywhere.
    """

    def chance(name: str, p: float) -> Column:
        return F.when(_draw(name) < p, 1).otherwise(0)

    return (
        _with_draws(ids, seed)
        .withColumns(
            {
                "age": x.clamp(F.lit(40.0) + F.lit(12.0) * _normal("age"), 18.0, 80.0),
                "is_business": F.when(_draw("is_business") < 0.7, 0).otherwise(1),
            }
        )
        .withColumn(
            "base_income",
            (F.lit(2000.0) + (F.col("age") - 25.0) * 50.0)
            * F.when(F.col("is_business") == 1, F.lit(1.5) + F.lit(1.5) * _draw("business_factor")).otherwise(1.0),
        )
        .withColumn(
            "monthly_income",
            F.greatest(
                F.lit(1000.0), F.col("base_income") + F.col("base_income") * 0.3 * _normal("monthly_income")
            ),
        )
        .withColumn(
            "monthly_expenses", F.col("monthly_income") * (F.lit(0.5) + F.lit(0.45) * _draw("expense_ratio"))
        )
        .withColumns(
            {
                "current_balance": F.greatest(
                    F.lit(0.0),
                    F.col("monthly_income") * 2.0 + F.col("monthly_income") * 0.5 * _normal("current_balance"),
                ),
                "expense_to_income_ratio": F.col("monthly_expenses") / F.col("monthly_income"),
                "savings_rate": (F.col("monthly_income") - F.col("monthly_expenses")) / F.col("monthly_income"),
                "overdrafts": F.when(_draw("has_overdrafts") < 0.3, _poisson("overdrafts", 1.0)).otherwise(0),
                "returned_payments": F.when(
                    _draw("has_returned") < 0.2, _poisson("returned_payments", 0.5)
                ).otherwise(0),
                "gambling_transactions": chance("gambling_transactions", 0.1),
                "irregular_income": chance("irregular_income", 0.15),
                "existing_credit_score": x.clamp(
                    F.lit(700.0) + F.lit(80.0) * _normal("existing_credit_score"), 300.0, 850.0
                ),
                "country_risk": _weighted_choice("country_risk", COUNTRY_DRAWS),
            }
        )
        .withColumn("good_credit_probability", label_probability())
        .withColumn(LABEL, F.when(_draw("label") < F.col("good_credit_probability"), 1).otherwise(0))
        .select("id", *FEATURES, "good_credit_probability", LABEL)
    )


def split_rows(
    df: DataFrame, key: str = "id", label: str = LABEL, share: Fraction = TRAINING_SHARE, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows: exactly floor(share * rows) of each label train, chosen by draws per key.

    The rows are fixed in the checkpoint folder first, as the counting passes and both parts read them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint()
    chosen = ranks.in_share(df, key, label, share, seed)
    return df.where(chosen), df.where(~chosen)


def fit(train: DataFrame, strength: float = 1.0) -> Scorecard:
    """The model features of all rows, standardised, in a logistic regression with an L2 penalty of ``strength``."""
    return logistic.fit(train, LABEL, FEATURES, strength)


def training_ids(spark: SparkSession, n: int = TRAINING_ROWS) -> DataFrame:
    """Ids for n synthetic applicants; a small set stays in few partitions."""
    return spark.range(0, n, 1, 1 + n // 100_000)


def save_model(card: Scorecard, spark: SparkSession, path: str) -> None:
    """Store a model as the next version of the table at ``path``; its readers go on with the version they opened."""
    swap_table(spark.createDataFrame(logistic.card_rows(card), logistic.CARD_SCHEMA).coalesce(1), path)


def load_model(spark: SparkSession, path: str) -> Scorecard | None:
    """The newest model stored at ``path``, or None."""
    stored = stored_rows(spark, current_path(spark, path), logistic.CARD_SCHEMA)
    rows = [] if stored is None else stored.collect()
    return logistic.card_of(rows) if rows else None


def train_or_load(spark: SparkSession, path: str, rows: DataFrame | None = None, retrain: bool = False) -> Scorecard:
    """The model saved at ``path``; trained on all of ``rows`` that train, and saved, if absent or if asked to."""
    held = None if retrain else load_model(spark, path)
    if held is not None:
        return held
    rows = training_rows(training_ids(spark)) if rows is None else rows
    card = fit(split_rows(rows)[0])
    save_model(card, spark, path)
    return card


def predict(card: Scorecard, features: DataFrame) -> DataFrame:
    """Score every row of ``features`` by plain column arithmetic."""
    return score_by_card(features, card).select(*features.columns, "probability", "credit_score", "risk_level")


def roc_auc(scored: DataFrame, label: str = LABEL, score: str = "probability") -> float:
    return ranks.auc_by_ranges(scored, label, score).first()["auc"]


def exact_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Counts of both labels and the area under the ROC curve for scores with few different values.

    Rows are counted per score first, so the window runs over one row per different score.
    """
    per_score = df.groupBy(score).agg(
        F.count_if(F.col(label) == 1).alias("good"), F.count_if(F.col(label) == 0).alias("bad")
    )
    below = F.sum("bad").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    pairs = per_score.withColumn("twice", F.col("good") * (F.coalesce(below, F.lit(0)) * 2 + F.col("bad")))
    return pairs.agg(
        F.sum("good").alias("n_good"),
        F.sum("bad").alias("n_bad"),
        F.round(F.sum("twice").cast("double") / 2 / (F.sum("good") * F.sum("bad")), 9).alias("auc"),
    )


def classification_report(df: DataFrame, label: str, prediction: str, where: Column | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class, from four counters in one pass.

    ``where`` limits the rows inside the counters. A filter on a computed label would be
    pushed below the projection and compute the label a second time.
    """
    y, p = F.col(label), F.col(prediction)
    counted = F.lit(True) if where is None else where
    cells = df.agg(
        *[F.count_if(counted & (y == a) & (p == b)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)]
    )
    per_class = F.array(
        *[
            F.struct(
                F.lit(c).alias("label"),
                F.col(f"n{c}{c}").alias("hits"),
                (F.col(f"n0{c}") + F.col(f"n1{c}")).alias("predicted"),
                (F.col(f"n{c}0") + F.col(f"n{c}1")).alias("support"),
            )
            for c in (0, 1)
        ]
    )
    rows = cells.select(F.explode(per_class).alias("c")).select("c.*")

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    rated = rows.withColumns(
        {"precision": ratio(F.col("hits"), F.col("predicted")), "recall": ratio(F.col("hits"), F.col("support"))}
    )
    both = F.col("precision") + F.col("recall")
    return rated.select(
        "label", "precision", "recall", ratio(F.col("precision") * F.col("recall") * 2.0, both).alias("f1"), "support"
    )
