"""Boundaries of the scalar rules on hand-made rows."""

import datetime

from pyspark.sql import functions as F

from ledgerlane.functions import exprs as x


def column(spark, schema, values, *exprs):
    df = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_score_bands(spark):
    scores = [300, 579, 580, 669, 670, 739, 740, 850, None]
    got = column(spark, "score int", scores, x.score_risk_level(), x.score_rating(), x.score_delta())
    assert [g[0] for g in got] == [
        "High Risk", "High Risk", "Medium Risk", "Medium Risk", "Medium-Low Risk", "Medium-Low Risk", "Low Risk",
        "Low Risk", None,
    ]
    assert [g[1] for g in got] == ["Poor", "Poor", "Fair", "Fair", "Good", "Good", "Excellent", "Excellent", None]
    assert got[0][2] == -350 and got[-1][2] is None


def test_overdue_bands(spark):
    days = [0, 14, 15, 29, 30, 31, 59, 60, 61, 90, 91, None]
    got = column(spark, "days_overdue int", days, x.seed_stage(), x.workflow_stage(), x.risk_band())
    assert [g[0] for g in got] == ["early"] * 4 + ["mid"] * 3 + ["late"] * 4 + [None]
    assert [g[1] for g in got] == ["current", "current", "early", "early", "early", "mid", "mid", "mid", "late", "late", "legal", None]
    assert [g[2] for g in got] == ["normal"] * 5 + ["elevated"] * 3 + ["high"] * 2 + ["critical", None]


def test_sentiment(spark):
    scores = [-1.0, -0.7, -0.5, 0.0, 0.5, 1.0, None]
    got = column(
        spark, "sentiment_score double", scores, x.sentiment_category(), x.sentiment_alert(),
        x.needs_escalation(), x.needs_escalation(threshold=-0.7),
    )
    assert [g[0] for g in got] == ["Negative"] * 3 + ["Neutral"] + ["Positive"] * 2 + [None]
    assert [g[1] for g in got] == ["negative", "negative", "neutral", "neutral", "neutral", "positive", "neutral"]
    assert [g[2] for g in got] == [True, True, False, False, False, False, False]
    assert [g[3] for g in got] == [True, False, False, False, False, False, False]


def test_indicators_default_to_zero(spark):
    texts = [
        '{"overdrafts": 2, "returned_payments": 1, "gambling_transactions": true, "irregular_income": true}',
        "{}",
        None,
        "{broken",
        '{"overdrafts": 3}',
    ]
    got = column(spark, "risk_indicators string", texts, x.parse_indicators().alias("i"), x.statement_risk(x.parse_indicators()))
    assert tuple(got[0][0]) == (2, 1, True, True) and got[0][1] == 2 * 2 + 3 + 5 + 3
    for row in got[1:4]:
        assert tuple(row[0]) == (0, 0, False, False) and row[1] == 0
    assert tuple(got[4][0]) == (3, 0, False, False)


def test_statement_risk_class(spark):
    got = column(spark, "r int", [0, 5, 6, 10, 11, None], x.statement_risk_class("r"))
    assert [g[0] for g in got] == ["low", "low", "medium", "medium", "high", None]


def test_ratios_without_income(spark):
    rows = [(100.0, 50.0), (0.0, 50.0), (-5.0, 50.0)]
    got = column(spark, "monthly_income double, monthly_expenses double", rows, x.expense_ratio(), x.savings_rate(),
                 x.expense_ratio(otherwise=None))
    assert got == [(0.5, 0.5, 0.5), (1.0, 0.0, None), (1.0, 0.0, None)]


def test_names(spark):
    rows = [("Acme", None, None), (None, "Ada", "King"), (None, "Ada", None), ("", "Ada", "King")]
    got = column(spark, "company_name string, first_name string, last_name string", rows, x.display_name())
    assert [g[0] for g in got] == ["Acme", "Ada King", "Ada", ""]


def test_padded_ids_keep_their_digits(spark):
    got = column(spark, "id long", [7, 42, 999, 1000, 123456], x.padded_id("LOAN", "id"))
    assert [g[0] for g in got] == ["LOAN007", "LOAN042", "LOAN999", "LOAN1000", "LOAN123456"]


def test_half_even_and_text(spark):
    got = column(spark, "v double", [650.5, 651.5, 2.5], x.half_even("v"))
    assert [g[0] for g in got] == [650.0, 652.0, 2.0]
    got = column(spark, "v double", [1234.5], x.money_text("v"), x.money_text("v", 0), x.percent_text(F.lit(0.123)))
    assert got[0][0] == "€1,234.50" and got[0][1] in ("€1,234", "€1,235") and got[0][2] == "12.3%"


def test_histogram_edges(spark):
    got = column(spark, "s int", [300, 327, 328, 849, 850], x.histogram_bin("s", 300, 850, 20))
    assert [g[0] for g in got] == [0, 0, 1, 19, 19]


def test_age_and_country(spark):
    born = [datetime.date(1980, 12, 31), datetime.date(1981, 1, 1), None]
    got = column(spark, "date_of_birth date", born, x.age_at("2001-12-31"))
    assert [g[0] for g in got] == [21, 20, 35]
    got = column(spark, "country string", ["Germany", "Netherlands", "Atlantis", None], x.country_risk())
    assert [g[0] for g in got] == [0.1, 0.05, 0.2, 0.2]


def test_payment_plan(spark):
    got = column(spark, "outstanding_amount double, start_date date", [(1200.0, datetime.date(2001, 2, 3))],
                 F.to_json(x.payment_plan()))
    assert got[0][0] == '{"monthly_payment":100.0,"duration_months":12,"interest_rate":0.05,"start_date":"2001-02-03"}'


def test_clamp_and_title(spark):
    got = column(spark, "v int", [1, 5, 9], x.clamp("v", 2, 8))
    assert [g[0] for g in got] == [2, 5, 8]
    assert column(spark, "t string", ["expense_to_income"], x.title_case("t")) == [("Expense To Income",)]
