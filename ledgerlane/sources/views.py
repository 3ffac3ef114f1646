"""The lending tables, as views over the star-schema parquet files.

``PROJECTIONS`` holds one select list per view, written so that Spark and the
SQL oracle read the same text. The two views that join or aggregate
(``credit_scores``, ``bank_statements``) are built here with the DataFrame API.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.sources.schemas import DDL
from ledgerlane.sources.sinks import current_path

TABLES = (
    "customers",
    "kyc_kyb_data",
    "credit_scores",
    "bank_statements",
    "marketing_campaigns",
    "customer_service",
    "collections",
)

# Ages and "today" are taken at this date.
AS_OF = "2001-12-31"

BUSINESS = "c_mktsegment IN ('MACHINERY','BUILDING')"

# view -> (source table, select list, row filter)
PROJECTIONS: dict[str, tuple[str, list[str], str | None]] = {
    "customers": (
        "customer",
        [
            "c_custkey AS id",
            f"CASE WHEN {BUSINESS} THEN 'business' ELSE 'individual' END AS customer_type",
            f"CASE WHEN {BUSINESS} THEN NULL ELSE 'Customer' END AS first_name",
            f"CASE WHEN {BUSINESS} THEN NULL ELSE substr(c_name, 10) END AS last_name",
            f"CASE WHEN {BUSINESS} THEN c_name ELSE NULL END AS company_name",
            "concat('c', CAST(c_custkey AS STRING), '@example.com') AS email",
            f"CASE WHEN {BUSINESS} THEN NULL ELSE make_date(CAST(1950 + c_custkey % 50 AS INT),"
            " CAST(1 + c_custkey % 12 AS INT), CAST(1 + c_custkey % 28 AS INT)) END AS date_of_birth",
            "CASE c_nationkey % 7 WHEN 0 THEN 'Germany' WHEN 1 THEN 'France' WHEN 2 THEN 'Italy'"
            " WHEN 3 THEN 'Spain' WHEN 4 THEN 'Poland' WHEN 5 THEN 'Netherlands' ELSE 'Other' END AS country",
            f"CASE WHEN {BUSINESS} THEN concat('HRB', CAST(100000 + c_custkey AS STRING)) ELSE NULL END"
            " AS registration_number",
        ],
        None,
    ),
    "kyc_kyb_data": (
        "customer",
        [
            "c_custkey AS id",
            "c_custkey AS customer_id",
            f"CASE WHEN {BUSINESS} THEN 'kyb' ELSE 'kyc' END AS verification_type",
            "CASE WHEN c_custkey % 10 = 0 THEN 'rejected' WHEN c_custkey % 10 < 3 THEN 'pending'"
            " ELSE 'approved' END AS verification_status",
            "CAST((c_custkey * 7919) % 1000 AS DOUBLE) / 1000 AS risk_score",
            "make_date(2001, CAST(1 + c_custkey % 12 AS INT), CAST(1 + c_custkey % 28 AS INT)) AS created_at",
        ],
        None,
    ),
    "marketing_campaigns": (
        "part",
        [
            "p_partkey AS id",
            "concat(p_name, ' ', CAST(p_partkey AS STRING)) AS campaign_name",
            "p_type AS target_audience",
            "CASE p_size % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'sms' WHEN 2 THEN 'social_media' ELSE 'web' END"
            " AS channel",
            "concat('AI-generated: ', p_name) AS ai_generated_content",
            "make_date(2001, CAST(1 + p_partkey % 12 AS INT), CAST(1 + p_partkey % 28 AS INT)) AS start_date",
            "p_retailprice * 50 AS budget",
            "CASE p_partkey % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'active' WHEN 2 THEN 'paused'"
            " ELSE 'completed' END AS status",
            "make_date(2000, CAST(1 + p_partkey % 12 AS INT), CAST(1 + p_partkey % 28 AS INT)) AS created_at",
        ],
        None,
    ),
    "customer_service": (
        "events",
        [
            "event_id AS id",
            "CASE WHEN event_id % 97 = 0 THEN -1 WHEN event_id % 89 = 0 THEN NULL ELSE user_id END AS customer_id",
            "CASE WHEN event_type IN ('click','view') THEN 'chat' WHEN event_type = 'purchase' THEN 'email'"
            " ELSE 'phone' END AS interaction_type",
            "CASE event_type WHEN 'error' THEN 'Account access issue' WHEN 'purchase' THEN 'Payment schedule question'"
            " WHEN 'signup' THEN 'Loan application inquiry' ELSE 'Interest rate information' END AS subject",
            "CASE WHEN event_type = 'signup' THEN NULL"
            " ELSE CAST((event_id * 7919) % 201 - 100 AS DOUBLE) / 100 END AS sentiment_score",
            "CASE event_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'resolved'"
            " ELSE 'closed' END AS resolution_status",
            "CASE event_id % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'urgent' ELSE 'medium' END AS priority",
            "ts AS created_at",
        ],
        None,
    ),
    "collections": (
        "orders",
        [
            "o_orderkey AS id",
            "o_custkey AS customer_id",
            "concat('LOAN', CAST(o_orderkey AS STRING)) AS loan_id",
            "o_totalprice AS outstanding_amount",
            "CAST((o_orderkey * 37) % 136 AS INT) AS days_overdue",
            "CASE WHEN o_orderkey % 29 = 0 THEN 'legal' WHEN (o_orderkey * 37) % 136 < 30 THEN 'early'"
            " WHEN (o_orderkey * 37) % 136 < 60 THEN 'mid' ELSE 'late' END AS collection_stage",
            "make_date(2001, CAST(1 + o_orderkey % 12 AS INT), CAST(1 + o_orderkey % 28 AS INT)) AS last_contact_date",
        ],
        "o_orderstatus = 'P'",
    ),
    # Views that break the declared constraints, for the quality audits only.
    "customers_raw": (
        "customer",
        [
            "c_custkey AS id",
            "CASE WHEN c_custkey % 41 = 0 THEN 'trust' WHEN c_custkey % 43 = 0 THEN NULL"
            f" WHEN {BUSINESS} THEN 'business' ELSE 'individual' END AS customer_type",
            "CASE WHEN c_custkey % 50 = 0 THEN 'shared@example.com' WHEN c_custkey % 47 = 0 THEN NULL"
            " ELSE concat('c', CAST(c_custkey AS STRING), '@example.com') END AS email",
        ],
        None,
    ),
    "credit_scores_raw": (
        "orders",
        [
            "o_orderkey AS id",
            "CASE WHEN o_orderkey % 61 = 0 THEN -o_custkey ELSE o_custkey END AS customer_id",
            "CASE WHEN o_orderkey % 53 = 0 THEN 900 WHEN o_orderkey % 59 = 0 THEN 299"
            " ELSE CAST(300 + (o_orderkey * 7919 + o_custkey) % 551 AS INT) END AS score",
        ],
        None,
    ),
    "kyc_kyb_data_raw": (
        "customer",
        [
            "c_custkey AS id",
            "CASE WHEN c_custkey % 61 = 0 THEN -c_custkey ELSE c_custkey END AS customer_id",
            "CASE WHEN c_custkey % 67 = 0 THEN 'kyx' WHEN c_custkey % 71 = 0 THEN NULL"
            f" WHEN {BUSINESS} THEN 'kyb' ELSE 'kyc' END AS verification_type",
            "CASE WHEN c_custkey % 73 = 0 THEN 'lost' WHEN c_custkey % 10 < 3 THEN 'pending' ELSE 'approved' END"
            " AS verification_status",
        ],
        None,
    ),
    "marketing_campaigns_raw": (
        "part",
        [
            "p_partkey AS id",
            "CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE p_name END AS campaign_name",
            "CASE WHEN p_partkey % 37 = 0 THEN 'multi-channel' WHEN p_partkey % 41 = 0 THEN NULL ELSE 'email' END AS channel",
            "CASE WHEN p_partkey % 31 = 0 THEN NULL WHEN p_partkey % 43 = 0 THEN 'archived' ELSE 'draft' END AS status",
        ],
        None,
    ),
    "customer_service_raw": (
        "events",
        [
            "event_id AS id",
            "CASE WHEN event_id % 97 = 0 THEN -1 WHEN event_id % 89 = 0 THEN NULL ELSE user_id END AS customer_id",
            "CASE WHEN event_id % 101 = 0 THEN 'fax' WHEN event_id % 103 = 0 THEN NULL ELSE 'chat' END AS interaction_type",
            "CASE WHEN event_id % 107 = 0 THEN 'lost' ELSE 'open' END AS resolution_status",
            "CASE WHEN event_id % 109 = 0 THEN 'none' ELSE 'low' END AS priority",
        ],
        None,
    ),
    "collections_raw": (
        "orders",
        [
            "o_orderkey AS id",
            "CASE WHEN o_orderkey % 47 = 0 THEN -o_custkey ELSE o_custkey END AS customer_id",
            "CASE WHEN o_orderkey % 43 = 0 THEN 'closed' ELSE 'early' END AS collection_stage",
        ],
        "o_orderstatus = 'P'",
    ),
}


def cents(col: Column | str) -> Column:
    """An amount as a whole number of cents. The sum of it is exact and cannot overflow."""
    value = F.col(col) if isinstance(col, str) else col
    return F.rint(value * 100).cast("bigint").cast("decimal(18,0)")


def money(col: Column | str, digits: int = 2) -> Column:
    """An amount as an exact decimal; sums of it do not depend on row order."""
    return (F.col(col) if isinstance(col, str) else col).cast(f"decimal(18,{digits})")


@dataclass(frozen=True)
class Lending:
    """Lazy handles on the lending tables below one directory."""

    spark: SparkSession
    root: str

    @cached_property
    def _opened(self) -> dict[str, DataFrame]:
        return {}

    def raw(self, table: str) -> DataFrame:
        """A source table; its files are listed and its schema is read once."""
        if table not in self._opened:
            self._opened[table] = self.spark.read.parquet(f"{self.root}/{table}.parquet")
        return self._opened[table]

    def view(self, name: str) -> DataFrame:
        if name in ("credit_scores", "bank_statements"):
            return getattr(self, name)
        source, columns, where = PROJECTIONS[name]
        frame = self.raw(source)
        return (frame.where(where) if where else frame).selectExpr(*columns)

    @cached_property
    def customers(self) -> DataFrame:
        return self.view("customers")

    @cached_property
    def kyc(self) -> DataFrame:
        return self.view("kyc_kyb_data")

    @cached_property
    def campaigns(self) -> DataFrame:
        return self.view("marketing_campaigns")

    @cached_property
    def service(self) -> DataFrame:
        return self.view("customer_service")

    @cached_property
    def collections(self) -> DataFrame:
        return self.view("collections")

    @cached_property
    def conversations(self) -> DataFrame:
        return self.raw("conversations")

    @cached_property
    def score_owners(self) -> DataFrame:
        """The customers whose scores count: individuals."""
        return self.customers.where("customer_type = 'individual'")

    @cached_property
    def score_facts(self) -> DataFrame:
        """Every bureau score, before the check that its customer is an individual.

        Per-customer aggregates run on this frame first and check the customer
        afterwards: the check only looks at the key, so both orders agree, and a
        customer with very many scores is one row by the time of the join.
        """
        return self.raw("orders").selectExpr(
            "o_orderkey AS id",
            "o_custkey AS customer_id",
            "CAST(300 + (o_orderkey * 7919 + o_custkey) % 551 AS INT) AS score",
            "CAST(o_orderdate AS DATE) AS score_date",
        )

    @cached_property
    def credit_scores(self) -> DataFrame:
        owners = self.score_owners.select(F.col("id").alias("customer_id"))
        return self.score_facts.join(owners, "customer_id", "left_semi").select(
            "id", "customer_id", "score", "score_date"
        )

    @cached_property
    def order_months(self) -> DataFrame:
        """All that is told per customer and month by one pass over the orders: sums of the statement, newest score."""
        price = cents("o_totalprice")
        score = F.expr("CAST(300 + (o_orderkey * 7919 + o_custkey) % 551 AS INT)")
        return (
            self.raw("orders")
            .groupBy(
                F.col("o_custkey").alias("customer_id"),
                F.trunc(F.col("o_orderdate").cast("date"), "month").alias("statement_date"),
            )
            .agg(
                F.sum(price * (45 + F.col("o_orderkey") % 60).cast("int")).alias("expenses"),
                F.count(F.lit(1)).alias("transaction_count"),
                F.sum(price).alias("salary"),
                F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("overdrafts"),
                F.count_if(F.col("o_orderstatus") == "P").alias("returned"),
                F.min(F.col("o_orderkey") % 10).alias("min_tenth"),
                F.max(F.col("o_orderkey") % 4).alias("max_fourth"),
                F.max(
                    F.struct(F.col("o_orderdate").cast("date").alias("score_date"), F.col("o_orderkey").alias("id"), score.alias("score"))
                ).alias("newest_score"),
            )
        )

    @cached_property
    def bank_statements(self) -> DataFrame:
        """One row per customer and month.

        The orders are summed to (customer, month) before they meet the customer
        table, so the join moves at most one row per month for any customer.
        """
        owners = self.raw("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_acctbal").alias("balance"))
        monthly = self.order_months.where(HAS_STATEMENTS).drop("newest_score")
        return monthly.join(owners, "customer_id").select("customer_id", *statement_columns())

    @cached_property
    def statement_facts(self) -> DataFrame:
        """Customer and month of every statement before the check of its owner, some keys spoiled for the audit."""
        owner = F.when(F.col("customer_id") % 59 == 0, -F.col("customer_id")).otherwise(F.col("customer_id"))
        return self.order_months.select(owner.alias("customer_id"), "statement_date")

    @cached_property
    def states(self) -> DataFrame:
        """Every customer with the newest score and the newest statement, from one scan of orders and one of customer.

        Null structs stand for customers without; scores count for individuals only.
        """
        parts = [c for c in self.order_months.columns if c not in ("customer_id", "newest_score")]
        newest = self.order_months.groupBy("customer_id").agg(
            F.max("newest_score").alias("s"), F.max(F.when(F.expr(HAS_STATEMENTS), F.struct(*parts))).alias("m")
        )
        columns = [c for c in PROJECTIONS["customers"][1] if c != "c_custkey AS id"]
        base = self.raw("customer").selectExpr("c_custkey AS customer_id", *columns, "c_acctbal AS account_balance")
        joined = base.join(newest, "customer_id", "left")
        flat = joined.select("*", *[F.col(f"m.{c}").alias(c) for c in parts], F.col("account_balance").alias("balance"))
        statement = F.struct(*statement_columns())
        return flat.select(
            *base.drop("account_balance").columns,
            F.when(F.col("customer_type") == "individual", F.struct("s.id", "s.score", "s.score_date"))
            .otherwise(F.lit(None)).alias("score_held"),
            F.when(F.col("m").isNotNull(), statement).alias("statement_held"),
        ).withColumn("score_held", F.when(F.col("score_held.id").isNotNull(), F.col("score_held")))


#: Customers with a number divisible by eleven have no statements.
HAS_STATEMENTS = "customer_id % 11 <> 0"


def statement_columns() -> list[Column]:
    """The columns of a statement from the sums of a month and the customer's balance."""
    day = F.col("statement_date").cast("string")
    salary = (F.col("salary") * F.lit("0.01").cast("decimal(2,2)")).cast("string")
    return [
        F.col("statement_date"),
        F.col("balance"),
        F.when(F.col("customer_id") % 13 == 0, 0.0).otherwise(F.col("salary").cast("double") / 100).alias("monthly_income"),
        (F.col("expenses").cast("double") / 100 / 100).alias("monthly_expenses"),
        F.col("transaction_count"),
        F.concat(
            F.lit('{"transactions": [{"date": "'), day,
            F.lit('", "description": "Salary", "amount": '), salary,
            F.lit('}, {"date": "'), day,
            F.lit('", "description": "Rent", "amount": -1200}]}'),
        ).alias("statement_data"),
        F.concat(
            F.lit('{"overdrafts": '), F.col("overdrafts").cast("string"),
            F.lit(', "returned_payments": '), F.col("returned").cast("string"),
            F.lit(', "gambling_transactions": '), F.when(F.col("min_tenth") == 0, "true").otherwise("false"),
            F.lit(', "irregular_income": '), F.when(F.col("max_fourth") == 3, "true").otherwise("false"),
            F.lit("}"),
        ).alias("risk_indicators"),
    ]


@dataclass(frozen=True)
class StoredLending(Lending):
    """The same tables where they are stored as such: one folder per table below the root."""

    def raw(self, table: str) -> DataFrame:
        if table not in self._opened:
            reader = self.spark.read.schema(DDL[table]) if table in DDL else self.spark.read
            self._opened[table] = reader.parquet(current_path(self.spark, f"{self.root}/{table}"))
        return self._opened[table]

    def view(self, name: str) -> DataFrame:
        return self.raw(name.removesuffix("_raw"))

    @cached_property
    def score_owners(self) -> DataFrame:
        return self.customers

    @cached_property
    def score_facts(self) -> DataFrame:
        return self.view("credit_scores")

    @cached_property
    def credit_scores(self) -> DataFrame:
        return self.view("credit_scores")

    @cached_property
    def bank_statements(self) -> DataFrame:
        return self.view("bank_statements")

    @cached_property
    def statement_facts(self) -> DataFrame:
        return self.bank_statements

    @cached_property
    def states(self) -> DataFrame:
        from ledgerlane.operators import customer360 as c360

        return c360.with_states(self.customers, c360.latest_score(self.score_facts), c360.latest_statement(self.bank_statements))


def register_views(lending: Lending) -> Lending:
    """Register the seven tables as temporary views, for SQL written by hand."""
    for name in TABLES:
        lending.view(name).createOrReplaceTempView(name)
    return lending
