"""Per-customer state: latest score, latest statement, verification summary, the joined profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.functions import exprs as x
from ledgerlane.operators.numbering import number_within
from ledgerlane.sources.views import money


def latest_per_customer(facts: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """The last row per customer by ``order``.

    ``max`` over a struct is combined on the map side, so each task sends one row
    per customer, however many rows that customer has.
    """
    rest = [c for c in columns if c not in order]
    last = F.max(F.struct(*order, *rest)).alias("last")
    return (
        facts.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(last)
        .select("customer_id", *[F.col(f"last.{c}").alias(c) for c in columns])
    )


def latest_score(scores: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Newest score per customer, the higher id winning a tie of dates.

    With ``owners`` the scores are reduced first and checked afterwards.
    """
    latest = latest_per_customer(scores, ["score_date", "id"], ["id", "score", "score_date"])
    if owners is None:
        return latest
    return latest.join(owners.select(F.col("id").alias("customer_id")), "customer_id", "left_semi")


STATEMENT_COLUMNS = [
    "statement_date",
    "balance",
    "monthly_income",
    "monthly_expenses",
    "transaction_count",
    "risk_indicators",
]


def latest_statement(statements: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Newest statement per customer; where statements have an id, the higher one wins a tie of dates."""
    order = ["statement_date", "id"] if "id" in statements.columns else ["statement_date"]
    return latest_per_customer(statements, order, columns or STATEMENT_COLUMNS)


def verification_summary(kyc: DataFrame) -> DataFrame:
    """Fixed-size summary of all verifications of a customer; the records stay in their table."""
    status = F.col("verification_status")
    return (
        kyc.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("kyc_count"),
            F.count_if(status == "approved").alias("kyc_approved"),
            F.count_if(status == "pending").alias("kyc_pending"),
            F.count_if(status == "rejected").alias("kyc_rejected"),
            F.max(F.struct("created_at", "id", "verification_type", "verification_status", "risk_score")).alias("k"),
        )
        .select(
            "customer_id",
            "kyc_count",
            "kyc_approved",
            "kyc_pending",
            "kyc_rejected",
            F.struct(
                "k.id", "k.verification_type", "k.verification_status", "k.risk_score", "k.created_at"
            ).alias("latest_kyc"),
        )
    )


def with_states(customers: DataFrame, latest_scores: DataFrame, latest_statements: DataFrame) -> DataFrame:
    """Every customer with the newest score and statement as structs, null where there is none."""

    def held(df: DataFrame, name: str) -> DataFrame:
        return df.select("customer_id", F.struct(*[c for c in df.columns if c != "customer_id"]).alias(name))

    return (
        customers.withColumnRenamed("id", "customer_id")
        .join(held(latest_scores, "score_held"), "customer_id", "left")
        .join(held(latest_statements, "statement_held"), "customer_id", "left")
    )


def customer_360(states: DataFrame, kyc: DataFrame) -> DataFrame:
    """Every customer once, with verification summary, latest score and latest statement."""
    statement = F.struct(*[F.col(f"statement_held.{c}").alias(c) for c in STATEMENT_COLUMNS])
    return (
        states.join(verification_summary(kyc), "customer_id", "left")
        .withColumns(
            {f"kyc_{s}": F.coalesce(f"kyc_{s}", F.lit(0)) for s in ("count", "approved", "pending", "rejected")}
        )
        .withColumns(
            {
                "credit_score": F.col("score_held"),
                "bank_statement": F.when(F.col("statement_held").isNotNull(), statement),
            }
        )
        .drop("score_held", "statement_held")
    )


def verifications(states: DataFrame, kyc: DataFrame) -> DataFrame:
    """Every customer with every verification record, a row each, the latest score and statement beside it.

    Customers without records stay with one row. Nothing is collected: a customer with very many
    records is that many rows, and adaptive execution may split them.
    """
    records = kyc.select(
        "customer_id", F.col("id").alias("kyc_id"), "verification_type", "verification_status", "risk_score",
        F.col("created_at").alias("kyc_created_at"),
    )
    return states.join(records, "customer_id", "left").select(
        "customer_id", "customer_type", "kyc_id", "verification_type", "verification_status", "risk_score",
        "kyc_created_at", F.col("score_held.score").alias("score"), F.col("score_held.score_date").alias("score_date"),
        F.col("statement_held.statement_date").alias("statement_date"),
        F.col("statement_held.monthly_income").alias("monthly_income"),
    )


RECORDS = ["id", "verification_type", "verification_status", "risk_score", "created_at"]


def service_contexts(states: DataFrame, kyc: DataFrame, size: int = 100) -> DataFrame:
    """What a reply is told about a customer, in numbered pieces of at most ``size`` verification records.

    Piece 1 holds the customer, the newest score and the newest statement; every piece holds its share of the records in
    order of date and id. Records are numbered by sorted ranges and grouped by (customer, piece), so a customer with a
    third of all records is many small groups. A customer without records has one piece with an empty list.
    """
    owned = kyc.where(F.col("customer_id").isNotNull()).select("customer_id", *RECORDS)
    numbered = number_within(owned, "customer_id", ["created_at", "id"])
    pieces = (
        numbered.groupBy("customer_id", F.floor((F.col("position") - 1) / size).alias("at"))
        .agg(F.array_sort(F.collect_list(F.struct("position", *RECORDS))).alias("held"))
        .select(
            "customer_id", (F.col("at") + 1).alias("piece"), F.size("held").cast("long").alias("n_records"),
            F.transform("held", lambda r: F.struct(*[r[c].alias(c) for c in RECORDS])).alias("records"),
        )
    )
    person = [c for c in states.columns if c not in ("customer_id", "score_held", "statement_held")]
    statement = F.struct(*[F.col(f"statement_held.{c}").alias(c) for c in STATEMENT_COLUMNS])
    joined = states.join(pieces, "customer_id", "left").withColumn("piece", F.coalesce("piece", F.lit(1).cast("long")))
    first = F.col("piece") == 1
    context = F.struct(
        F.when(first, F.struct(F.col("customer_id").alias("id"), *person)).alias("customer"),
        F.coalesce("records", F.array().cast(pieces.schema["records"].dataType)).alias("kyc_data"),
        F.when(first, F.col("score_held")).alias("credit_score"),
        F.when(first & F.col("statement_held").isNotNull(), statement).alias("bank_statement"),
    )
    return joined.select(
        "customer_id", "piece", F.coalesce("n_records", F.lit(0).cast("long")).alias("n_records"),
        F.to_json(context, {"ignoreNullFields": "false"}).alias("context"),
    )


def statement_trends(statements: DataFrame) -> DataFrame:
    """Net flow, change against the statement before, and each customer's averages.

    Averages come from one reduction per customer. The change needs the statement before: statements
    are ordered in windows of one customer and year, and one row per customer and year carries the
    last net flow over the border, so a customer with a third of all statements is cut by years.
    Equal dates are ordered by id where statements have one.
    """
    income, expenses = money("monthly_income", 4), money("monthly_expenses", 4)
    net = income - expenses
    # ten-thousandths as whole numbers
    tenths = F.rint(F.col("monthly_income") * 10000).cast("bigint").cast("decimal(18,0)")
    order = ["statement_date", "id"] if "id" in statements.columns else ["statement_date"]
    rows = statements.select(
        "customer_id", *order, "monthly_income", "monthly_expenses", F.year("statement_date").alias("year"), net.alias("net")
    )
    by_year = Window.partitionBy("customer_id", "year").orderBy(*order)
    years = rows.groupBy("customer_id", "year").agg(
        F.max(F.struct(*order, "net")).alias("last"),
        F.count(F.lit(1)).alias("n"),
        F.sum(income).alias("income"),
        # exact sums, so the order of rows cannot move the result
        F.sum(tenths * tenths).alias("squares"),
        F.sum(tenths).alias("tenths"),
        F.sum(x.expense_ratio().cast("decimal(20,12)")).alias("ratios"),
    )
    along = Window.partitionBy("customer_id").orderBy("year")
    every = Window.partitionBy("customer_id")
    n = F.sum("n").over(every)
    mean = F.sum("income").over(every).cast("double") / n
    carried = years.select(
        "customer_id",
        "year",
        F.lag("last.net").over(along).alias("carried"),
        n.alias("months"),
        mean.alias("income_mean"),
        (F.sum("squares").over(every).cast("decimal(38,0)") * n.cast("decimal(10,0)")).alias("scaled_squares"),
        (F.sum("tenths").over(every).cast("decimal(19,0)") * F.sum("tenths").over(every).cast("decimal(19,0)")).alias("squared_sum"),
        (F.sum("ratios").over(every).cast("double") / n).alias("expense_ratio_mean"),
    )
    before = F.coalesce(F.lag("net").over(by_year), F.col("carried"))
    return (
        rows.join(carried, ["customer_id", "year"])
        .select(
            "customer_id",
            "statement_date",
            F.col("net").cast("double").alias("net_flow"),
            (F.col("net") - before).cast("double").alias("net_change"),
            "months",
            "income_mean",
            (F.sqrt((F.col("scaled_squares") - F.col("squared_sum")).cast("double")) / F.col("months") / 10000).alias("income_sd"),
            "expense_ratio_mean",
        )
    )


def income_allocation(statements: DataFrame) -> DataFrame:
    """Income, expenses and net savings as rows, with the shares where something was saved."""
    income, expenses = money("monthly_income", 4), money("monthly_expenses", 4)
    net = (income - expenses).cast("double")
    saved = (F.col("monthly_income") > 0) & (net > 0)
    parts = F.array(
        F.struct(F.lit("Income").alias("category"), F.col("monthly_income").alias("amount"), F.lit(False).alias("in_pie")),
        F.struct(F.lit("Expenses").alias("category"), F.col("monthly_expenses").alias("amount"), saved.alias("in_pie")),
        F.struct(F.lit("Net Savings").alias("category"), net.alias("amount"), saved.alias("in_pie")),
    )
    return statements.select(
        "customer_id", x.expense_ratio(otherwise=None).alias("expense_ratio"), F.explode(parts).alias("p")
    ).select("customer_id", "expense_ratio", "p.category", "p.amount", F.col("p.in_pie").alias("allocated"))
