"""Features, scorecard, training rows and the fitted model."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlane.operators import logistic
from ledgerlane.operators import scoring as s
from ledgerlane.operators import training as t
from ledgerlane.plans import credit


@pytest.fixture(scope="module")
def rows(spark):
    return t.training_rows(t.training_ids(spark, 3000)).cache()


@pytest.fixture(scope="module")
def model(rows):
    return t.fit(t.split_rows(rows)[0])


def profile(spark, *rows):
    return spark.createDataFrame(
        rows,
        "customer_id long, customer_type string, company_name string, first_name string, last_name string, email string,"
        " date_of_birth date, country string, score int, monthly_income double, monthly_expenses double, balance double,"
        " risk_indicators string",
    )


def test_features_without_statement_and_score(spark):
    df = profile(spark, (1, "business", "Acme", None, None, "e", None, None, None, None, None, None, None))
    row = s.credit_features(df, "2001-12-31").first()
    assert [row[f] for f in s.FEATURES] == [35, 1, 0, 0, 0, 1.0, 0.0, 0, 0, 0, 0, 650, 0.2]


def test_fallback_values(spark):
    df = profile(spark, (1, "business", "Acme", None, None, "e", None, "Poland", 700, 100.0, 20.0, 5.0, '{"overdrafts": 2}'))
    row = s.credit_features(df, "2001-12-31", reference_defaults=True).first()
    assert (row.age, row.is_business, row.country_risk) == (35, 0, 0.1)
    assert (row.expense_to_income_ratio, row.savings_rate, row.overdrafts, row.existing_credit_score) == (0.2, 0.8, 2, 700)


def test_scorecard_by_hand(spark, lending):
    features = s.lending_features(lending, "2001-12-31")
    for row in s.score_by_card(features).limit(50).collect():
        z = s.PINNED.intercept + sum(w.coefficient * (row[w.feature] - w.mean) / w.std for w in s.PINNED.weights)
        p = 1 / (1 + math.exp(-z))
        assert abs(row.probability - p) < 1e-12 and row.credit_score == int(np.round(300 + p * 550))
        assert 300 <= row.credit_score <= 850


def test_contributions_add_up_and_rank(spark, lending):
    features = s.lending_features(lending, "2001-12-31")
    every = s.feature_contributions(features)
    assert every.groupBy("customer_id").count().where("count <> 13").count() == 0
    top = s.feature_contributions(features, top=8).collect()
    assert max(r.impact_rank for r in top) == 8
    ordered = {}
    for r in sorted(top, key=lambda r: r.impact_rank):
        ordered.setdefault(r.customer_id, []).append(abs(r.impact_raw))
    assert all(v == sorted(v, reverse=True) for v in ordered.values())


def test_training_rows_do_not_depend_on_partitions(spark):
    few = t.training_rows(spark.range(0, 500, 1, 1)).collect()
    many = t.training_rows(spark.range(0, 500, 1, 13)).collect()
    assert sorted(few) == sorted(many)


def test_training_distributions(rows):
    got = rows.agg(
        F.avg("age"), F.avg("is_business"), F.min("age"), F.max("age"), F.avg("overdrafts"), F.avg("returned_payments"),
        F.avg("gambling_transactions"), F.avg("existing_credit_score"), F.avg("country_risk"), F.min("monthly_income"),
        F.avg("expense_to_income_ratio"),
    ).first()
    assert abs(got[0] - 40) < 1 and abs(got[1] - 0.3) < 0.03 and got[2] >= 18 and got[3] <= 80
    assert abs(got[4] - 0.3) < 0.05 and abs(got[5] - 0.1) < 0.03 and abs(got[6] - 0.1) < 0.02
    assert abs(got[7] - 700) < 6 and abs(got[8] - 0.175) < 0.005 and got[9] >= 1000 and abs(got[10] - 0.725) < 0.01


def test_poisson_steps():
    steps = t.poisson_steps(1.0)
    assert abs(steps[0] - math.exp(-1)) < 1e-15 and steps == sorted(steps) and abs(steps[-1] - 1) < 1e-8


def test_split_is_exact_for_each_label(rows):
    train, test = t.split_rows(rows)
    assert train.count() + test.count() == rows.count() and train.join(test, "id").count() == 0
    for label in (0, 1):
        n = rows.where(F.col(t.LABEL) == label).count()
        assert train.where(F.col(t.LABEL) == label).count() == n * 4 // 5


def test_fit_equals_newton_solution(rows, model):
    data = t.split_rows(rows)[0].select(*s.FEATURES, t.LABEL).toPandas().to_numpy(dtype=float)
    features, y = data[:, :-1], data[:, -1]
    # savings_rate is one minus the expense ratio, so only the penalty makes the solution unique.
    z = (features - features.mean(0)) / features.std(0)
    design = np.hstack([np.ones((len(z), 1)), z])
    penalty = np.diag([0.0] + [1.0] * z.shape[1])
    w = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (p - y) + penalty @ w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + penalty
        w -= np.linalg.solve(hessian, gradient)
    assert abs(model.intercept - w[0]) < 1e-9
    assert np.allclose([k.coefficient for k in model.weights], w[1:], atol=1e-9)
    assert np.allclose([k.mean for k in model.weights], features.mean(0))
    assert np.allclose([k.std for k in model.weights], features.std(0))


def test_gradient_vanishes_at_the_fit_only(rows, model):
    train = t.split_rows(rows)[0]
    found = logistic.gradient(train, t.LABEL, model).collect()
    assert len(found) == 14 and {r.n_rows for r in found} == {train.count()}
    assert max(abs(r.gradient) for r in found) < 1e-6
    assert max(abs(r.gradient) for r in logistic.gradient(train, t.LABEL, s.PINNED).collect()) > 1


def test_fit_beyond_its_sample(spark, monkeypatch):
    """The starting sample moves the first step only: tables far above and below it give the same minimum."""
    rows = t.training_rows(spark.range(0, 6000, 1, 5)).cache()
    whole = logistic.fit(rows, t.LABEL)
    monkeypatch.setattr(logistic, "SAMPLED", 50)
    few = logistic.fit(rows.repartition(7), t.LABEL)
    assert np.allclose([w.coefficient for w in whole.weights], [w.coefficient for w in few.weights], atol=1e-8)


def test_fit_with_nulls_constants_and_separable_labels(spark):
    rows = [(float(k), 7.0, int(k >= 20)) for k in range(40)] + [(None, 1.0, 1), (1.0, 1.0, None)]
    card = logistic.fit(spark.createDataFrame(rows, "a double, b double, y int"), "y", ["a", "b"])
    assert card.weights[0].coefficient > 1 and abs(card.weights[1].coefficient) < 1e-9
    with pytest.raises(ValueError):
        logistic.fit(spark.createDataFrame([(1.0, 1)], "a double, y int"), "y", ["a"])
    with pytest.raises(ValueError):
        logistic.fit(spark.createDataFrame([], "a double, y int"), "y", ["a"])


def test_held_out_auc_and_report(rows, model):
    scored = t.predict(model, t.split_rows(rows)[1])
    assert t.roc_auc(scored) > 0.6
    report = t.classification_report(
        scored.withColumn("prediction", F.when(F.col("probability") >= 0.5, 1).otherwise(0)), t.LABEL, "prediction"
    ).collect()
    assert sum(r.support for r in report) == scored.count()


def test_report_by_hand(spark):
    pairs = [(1, 1)] * 3 + [(1, 0)] + [(0, 1)] * 2 + [(0, 0)] * 4
    got = {r.label: r for r in t.classification_report(spark.createDataFrame(pairs, "y int, p int"), "y", "p").collect()}
    assert (got[1].precision, got[1].recall, got[1].support) == (0.6, 0.75, 4)
    assert abs(got[1].f1 - 2 * 0.6 * 0.75 / 1.35) < 1e-12
    assert (got[0].precision, got[0].support) == (0.8, 6)


def test_train_once_then_load(spark, rows, tmp_path):
    path = str(tmp_path / "model")
    assert t.load_model(spark, path) is None
    first = t.train_or_load(spark, path, rows)
    assert t.train_or_load(spark, path, rows.limit(0)) == first == t.load_model(spark, path)
    fresh = t.train_or_load(spark, path, rows.where("id < 1500"), retrain=True)
    assert fresh != first and t.load_model(spark, path) == fresh


def test_scores_by_a_given_and_by_a_stored_model(spark, lending, model, tmp_path):
    path = str(tmp_path / "model")
    with pytest.raises(ValueError):
        credit.batch_scores(lending, path)
    t.save_model(model, spark, path)
    given, stored = (sorted(credit.batch_scores(lending, m).collect()) for m in (model, path))
    assert given == stored and len(given) == lending.customers.count()
    fitted = credit.batch_scoring(lending)
    assert fitted.columns == credit.batch_scores(lending, model).columns and fitted.count() == len(given)


def test_batch_scores_plan_without_a_job(spark, lending, model):
    spark.sparkContext.setJobGroup("plans only", "")
    try:
        credit.batch_scores(lending, model)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("plans only")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
