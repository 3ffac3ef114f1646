"""Per-customer operators, reports with orphans and ties, and joins with a hot key."""

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlane.operators import customer360 as c360
from ledgerlane.operators import reports as r
from ledgerlane.operators.skew import join_splitting_hot_keys
from ledgerlane.sources.views import Lending

DAY = datetime.date


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame(
        [(1, None, "Ada", "King", "a@x"), (2, "Acme", None, None, "b@x"), (3, None, "Bo", "Ek", "c@x")],
        "id long, company_name string, first_name string, last_name string, email string",
    )


def test_latest_score_breaks_ties_by_id(spark):
    rows = [(1, 7, 500, DAY(2001, 1, 1)), (2, 7, 600, DAY(2001, 5, 1)), (3, 7, 700, DAY(2001, 5, 1)), (4, 8, 300, None),
            (5, None, 400, DAY(2001, 1, 1))]
    scores = spark.createDataFrame(rows, "id long, customer_id long, score int, score_date date")
    got = {x.customer_id: (x.id, x.score) for x in c360.latest_score(scores).collect()}
    assert got == {7: (3, 700), 8: (4, 300)}
    kept = c360.latest_score(scores, spark.createDataFrame([(8,)], "id long")).collect()
    assert [x.customer_id for x in kept] == [8]


def test_one_hot_customer_is_one_row(spark):
    scores = spark.range(60000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("customer_id"),
        F.lit(500).alias("score"),
        F.date_add(F.lit("2001-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("score_date"),
    )
    latest = c360.latest_score(scores)
    hot = latest.where("customer_id = 1").collect()
    best = max((i % 300, i) for i in range(60000) if i % 3 == 0 or i == 1)
    assert len(hot) == 1 and hot[0].id == best[1]
    assert latest.count() == latest.select("customer_id").distinct().count()


def test_profile_keeps_customers_without_children(spark, lending):
    profile = c360.customer_360(lending.states, lending.kyc)
    rows = profile.collect()
    assert len(rows) == lending.customers.count() == len({x.customer_id for x in rows})
    assert any(x.bank_statement is None for x in rows) and any(x.credit_score is None for x in rows)
    assert sum(x.kyc_count for x in rows) == lending.kyc.count()


def test_latest_with_customer_skips_orphans(spark, customers):
    facts = spark.range(1000).select(
        "id",
        F.when(F.col("id") >= 700, -1).otherwise(F.col("id") % 3 + 1).alias("customer_id"),
        F.date_add(F.lit("2001-01-01").cast("date"), (F.col("id") / 50).cast("int")).alias("created_at"),
    )
    expected = list(range(699, 694, -1))
    assert [x.id for x in r.latest_with_customer(facts, customers, 5).collect()] == expected


def test_latest_with_customer_when_few_exist(spark, customers):
    facts = spark.createDataFrame([(1, 1, None), (2, -1, DAY(2001, 1, 1)), (3, 2, DAY(2001, 1, 1))],
                                  "id long, customer_id long, created_at date")
    assert [x.id for x in r.latest_with_customer(facts, customers, 5).collect()] == [3, 1]


def test_counts_add_up(lending):
    grid = r.overdue_grid(lending.collections, lending.customers).agg(F.sum("n")).first()[0]
    zero = r.zero_filled_counts(lending.collections, "collection_stage", ["early", "mid", "late", "legal", "none"])
    assert grid == lending.collections.count() == zero.agg(F.sum("n")).first()[0]
    assert zero.where("collection_stage = 'none'").first().n == 0


def test_in_sets_none_means_all(lending):
    assert r.in_sets(lending.campaigns, {"status": None}).count() == lending.campaigns.count()
    assert r.in_sets(lending.campaigns, {"status": []}).count() == 0


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_hot_key_join_equals_plain_join(spark, how):
    facts = spark.range(9000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 400).alias("k"),
    )
    dim = spark.range(0, 300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = join_splitting_hot_keys(facts, dim, "k", how, "id", pieces=8)
    plain = facts.join(dim, "k", how)
    assert sorted(got.columns) == sorted(plain.columns)
    assert Counter(map(tuple, got.select(plain.columns).collect())) == Counter(map(tuple, plain.collect()))


def test_hot_key_is_cut(spark):
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"))
    dim = spark.range(0, 3000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    plan = join_splitting_hot_keys(facts, dim, "k", "left", "id", pieces=16)._jdf.queryExecution().toString()
    assert "hashpartitioning(k" in plan and "piece" in plan


def test_lending_views_match_declared_shape(spark, lending):
    from ledgerlane.sources.schemas import table_schema
    from ledgerlane.sources.views import TABLES

    for table in TABLES:
        declared = {f.name: f.dataType.simpleString() for f in table_schema(table)}
        for field in lending.view(table).schema:
            assert field.name in declared
            if field.dataType.simpleString() in ("string", "double"):
                assert declared[field.name] == field.dataType.simpleString()


def test_statement_trends_of_one_customer(spark):
    rows = [(1, DAY(2001, 1, 1), 100.0, 40.0), (1, DAY(2001, 2, 1), 0.0, 10.0), (1, DAY(2001, 3, 1), 200.0, 50.0)]
    df = spark.createDataFrame(rows, "customer_id long, statement_date date, monthly_income double, monthly_expenses double")
    got = c360.statement_trends(df).orderBy("statement_date").collect()
    assert [x.net_flow for x in got] == [60.0, -10.0, 150.0]
    assert [x.net_change for x in got] == [None, -70.0, 160.0]
    assert got[0].income_mean == 100.0 and abs(got[0].expense_ratio_mean - (0.4 + 1.0 + 0.25) / 3) < 1e-12


def test_statement_trends_over_years_and_equal_dates(spark):
    rows = [(k, 1, DAY(2000 + k // 4, 1 + k % 2, 1), float(k * k), 1.0) for k in range(12)]
    df = spark.createDataFrame(
        rows, "id long, customer_id long, statement_date date, monthly_income double, monthly_expenses double"
    ).repartition(3)
    got = c360.statement_trends(df).collect()
    by_order = sorted(rows, key=lambda r: (r[2], r[0]))
    nets = [r[3] - r[4] for r in by_order]
    wanted = [(n, None if i == 0 else n - nets[i - 1]) for i, n in enumerate(nets)]
    assert sorted(map(str, ((x.net_flow, x.net_change) for x in got))) == sorted(map(str, wanted))
    mean = sum(r[3] for r in rows) / 12
    sd = (sum((r[3] - mean) ** 2 for r in rows) / 12) ** 0.5
    assert all(x.months == 12 and abs(x.income_sd - sd) < 1e-9 and abs(x.income_mean - mean) < 1e-12 for x in got)


def test_states_equal_the_separate_reductions(spark, lending):
    held = {x.customer_id: x for x in lending.states.collect()}
    scores = c360.latest_score(lending.score_facts, lending.score_owners).collect()
    statements = c360.latest_statement(lending.bank_statements).collect()
    assert {x.customer_id: tuple(x)[1:] for x in scores} == {
        k: (v.score_held.id, v.score_held.score, v.score_held.score_date) for k, v in held.items() if v.score_held
    }
    assert {x.customer_id: (x.statement_date, x.balance, x.risk_indicators) for x in statements} == {
        k: (v.statement_held.statement_date, v.statement_held.balance, v.statement_held.risk_indicators)
        for k, v in held.items() if v.statement_held
    }


def test_income_allocation_only_with_savings(spark):
    rows = [(1, 100.0, 40.0), (2, 100.0, 120.0), (3, 0.0, 10.0)]
    df = spark.createDataFrame(rows, "customer_id long, monthly_income double, monthly_expenses double")
    got = {(x.customer_id, x.category): (x.amount, x.allocated, x.expense_ratio) for x in c360.income_allocation(df).collect()}
    assert got[1, "Net Savings"] == (60.0, True, 0.4) and got[2, "Net Savings"] == (-20.0, False, 1.2)
    assert got[3, "Expenses"] == (10.0, False, None)


def test_views_can_be_queried_by_hand(spark):
    from conftest import SMALL

    from ledgerlane.sources.views import register_views

    register_views(Lending(spark, SMALL))
    n = spark.sql("SELECT count(*) FROM collections k JOIN customers c ON k.customer_id = c.id").first()[0]
    assert n == Lending(spark, SMALL).collections.count()
