"""Queries on tables where one key holds a third of the rows, with no broadcast by size."""

import pytest
from oracle_check import difference
from pyspark.sql import functions as F

import __spark_entry__ as entry

NAMES = [
    "collections_worklist", "collections_totals", "outstanding_by_stage", "overdue_heatmap", "score_history",
    "latest_score", "latest_statement", "customer_360", "statement_trends", "scorecard_scores", "score_histogram",
    "top_feature_impacts", "conversation_context", "turn_numbering", "onboarding_messages", "recent_interactions_10",
    "campaign_content_lookup", "collection_email_prompts", "dq_fk_orphans", "dq_unique_email", "service_kpis",
    "apply_email_updates", "column_profile", "q_scores_below_600",
]

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
}


def draw(n, seed):
    return F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(n))


def one_of(values, seed):
    return F.element_at(F.array(*map(F.lit, values)), (draw(len(values), seed) + 1).cast("int"))


def hot(key, other, column="id"):
    return F.when(F.col(column) % 3 == 0, key).otherwise(other)


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("skewed"))
    customers, orders, events, turns = 400, 12000, 6000, 3000
    tables = {
        "customer": spark.range(customers).select(
            F.col("id").alias("c_custkey"),
            F.format_string("Customer#%09d", "id").alias("c_name"),
            (F.col("id") % 25).cast("int").alias("c_nationkey"),
            (draw(1000000, 1) / 100).alias("c_acctbal"),
            one_of(["MACHINERY", "BUILDING", "HOUSEHOLD", "FURNITURE", "AUTOMOBILE"], 2).alias("c_mktsegment"),
        ),
        "orders": spark.range(orders).select(
            F.col("id").alias("o_orderkey"),
            hot(8, draw(customers + 20, 3)).alias("o_custkey"),
            one_of(["F", "O", "P"], 4).alias("o_orderstatus"),
            (draw(50000000, 5) / 100).alias("o_totalprice"),
            F.expr("timestamp_ntz'1995-01-01' + make_dt_interval(cast(id % 2400 as int))").alias("o_orderdate"),
            one_of(["1-URGENT", "2-HIGH", "5-LOW"], 6).alias("o_orderpriority"),
        ),
        "part": spark.range(500).select(
            F.col("id").alias("p_partkey"),
            F.lit("small ring").alias("p_name"),
            F.lit("Brand#1").alias("p_brand"),
            one_of(["ECONOMY", "SMALL", "PROMO"], 7).alias("p_type"),
            (draw(50, 8) + 1).cast("int").alias("p_size"),
            (900 + draw(100000, 9) / 100).alias("p_retailprice"),
        ),
        "events": spark.range(events).select(
            F.col("id").alias("event_id"),
            F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(id as int))").alias("ts"),
            hot(8, draw(customers, 10)).alias("user_id"),
            one_of(["view", "click", "signup", "purchase", "error"], 11).alias("event_type"),
            F.lit(1.0).alias("value"),
            F.lit("{}").alias("props"),
        ),
        "conversations": spark.range(turns).select(
            hot(0, 1 + F.floor(F.col("id") / 30)).cast("bigint").alias("conv_id"),
            F.when(F.col("id") % 3 == 0, (F.col("id") / 3).cast("bigint")).otherwise(F.col("id") % 30).alias("turn"),
            one_of(["user", "assistant"], 12).alias("role"),
            F.concat(F.lit("text\n"), F.col("id").cast("string")).alias("text"),
        ),
    }
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}.parquet")
    return root


@pytest.fixture(scope="module")
def duck(skewed):
    import duckdb

    connection = duckdb.connect()
    for table in ("customer", "orders", "part", "events", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{skewed}/{table}.parquet/*.parquet')")
    return connection


@pytest.fixture(autouse=True)
def no_broadcast_by_size(spark):
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key in SETTINGS:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", NAMES)
def test_skewed(name, spark, skewed, duck):
    assert difference(entry.queries()[name](spark, skewed), duck, entry.oracle_sql()[name]) is None
