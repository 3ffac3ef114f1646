"""Every named query against its SQL, and the shape of every plan."""

import pytest
from conftest import SMALL
from oracle_check import connect, difference

import __spark_entry__ as entry
from ledgerlane import plans

QUERIES = {name: run for name, run in entry.queries().items() if name in plans.QUERIES}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in plans.QUERIES}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, duck):
    assert difference(QUERIES[name](spark, SMALL), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_gives_rows(name, spark):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python(name, spark):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas"):
        assert operator not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["high_risk_accounts"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,P)" in plan
    orders = [line for line in plan.splitlines() if "orders.parquet" in line]
    assert orders and all("o_orderpriority" not in line for line in orders)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and sum(r.accounts for r in rows) == QUERIES["collections_worklist"](spark, SMALL).count()


def test_one_shuffle_per_child_table_in_the_profile(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["customer_360"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # customers, checks, months by customer and month, months by customer
    assert plan.count("Exchange hashpartitioning") <= 4
    assert plan.count("orders.parquet") == 1


@pytest.mark.parametrize("name", ["feature_contributions", "scorecard_scores"])
def test_features_read_each_table_once(name, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("orders.parquet") == 1 and plan.count("customer.parquet") == 1
    assert plan.count("Exchange hashpartitioning") <= 3


@pytest.mark.parametrize("name", ["dq_enum_domain", "dq_not_null", "dq_fk_orphans"])
def test_every_audited_row_counts_something(name, spark):
    rows = QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    assert rows and all(r[c] > 0 for r in rows for c in r.asDict() if c.startswith("n_"))
