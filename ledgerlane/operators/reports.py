"""Joins, rankings and roll-ups shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions import exprs as x
from ledgerlane.sources.views import cents


def with_customer(facts: DataFrame, customers: DataFrame) -> DataFrame:
    """Inner join to the owning customer. Rows without a known customer drop out.

    Nothing is aggregated on the key here, so adaptive execution is free to split
    the partition of a customer that owns a large share of the rows.
    """
    owners = customers.select(F.col("id").alias("customer_id"), x.display_name().alias("customer"), "email")
    return facts.join(owners, "customer_id")


def owned(facts: DataFrame, customers: DataFrame) -> DataFrame:
    """Rows whose customer exists, without reading any customer attribute."""
    return facts.join(customers.select(F.col("id").alias("customer_id")), "customer_id", "left_semi")


def owned_sums(
    facts: DataFrame, customers: DataFrame, sums: dict[str, Column], by: tuple[str, ...] = ()
) -> DataFrame:
    """Sums or counts over the rows of known customers, in all or per group.

    Rows are reduced per customer and group before the check, so a customer with very
    many rows is a few rows per task. Without groups the check reuses that shuffle.
    """
    reduced = facts.groupBy("customer_id", *by).agg(*[s.alias(n) for n, s in sums.items()])
    return owned(reduced, customers).groupBy(*by).agg(*[F.sum(n).alias(n) for n in sums])


def newest_first(*order: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in order or ("created_at", "id")]


def latest_with_customer(
    facts: DataFrame, customers: DataFrame, n: int, order: tuple[str, ...] = ("created_at", "id")
) -> DataFrame:
    """The n newest rows that have a customer.

    Orphans mean the n newest rows cannot simply be cut before the join. The check runs on
    (customer, order) alone; the n keys that survive fetch the wide rows, and those their customers.
    """
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    owned_keys = owned(facts.select("customer_id", key.alias("k")), customers)
    # the n-th newest key with an owner; rows below it are left out before they meet the customers
    floor = owned_keys.orderBy(F.col("k").desc()).limit(n).agg(F.min("k").alias("floor")).scalar()
    recent = facts.where(key >= floor)
    return with_customer(recent, customers).orderBy(*newest_first(*order)).limit(n)


def counts(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def zero_filled_counts(df: DataFrame, key: str, values: list[str], name: str = "n") -> DataFrame:
    """One row per listed value, 0 where it is absent: one aggregate, no join."""
    return as_rows(df.agg(*[c.alias(v) for v, c in counters(key, values).items()]), key, values, name)


def counters(key: str, values: list[str]) -> dict[str, Column]:
    return {v: F.count_if(F.col(key) == v) for v in values}


def as_rows(row: DataFrame, key: str, values: list[str], name: str = "n") -> DataFrame:
    """A row of counts turned into one row per value; a count over nothing is 0."""
    return row.select([F.coalesce(v, F.lit(0)).alias(v) for v in values]).unpivot([], list(values), key, name)


def total_money(col: Column | str) -> Column:
    return F.sum(cents(col)).cast("double") / 100


def mean_money(col: Column | str) -> Column:
    return F.try_divide(total_money(col), F.count(col))


def in_sets(df: DataFrame, allowed: dict[str, list | None]) -> DataFrame:
    """Keep rows whose columns lie in the given sets; None means no restriction."""
    for column, values in allowed.items():
        if values is not None:
            df = df.where(F.col(column).isin(list(values)))
    return df


def distinct_options(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values of several columns from one scan, as (option_set, value)."""
    return df.select(columns).unpivot([], columns, "option_set", "value").distinct()


def found_in(df: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Rows whose key was asked for: many lookups as one join. Both sides come straight from a shuffle,
    so adaptive execution splits a key that holds many rows."""
    return df.join(requests.select(key).distinct(), key, "left_semi")


def overdue_grid(accounts: DataFrame, customers: DataFrame, days: int = 30, amount: int = 1000) -> DataFrame:
    """Accounts and amounts per cell of days overdue and amount outstanding."""
    placed = accounts.select(
        "customer_id",
        "outstanding_amount",
        F.floor(F.col("days_overdue") / days).cast("int").alias("days_bin"),
        F.floor(F.col("outstanding_amount") / amount).cast("bigint").alias("amount_bin"),
    )
    sums = {"n": F.count(F.lit(1)), "owed": F.sum(cents("outstanding_amount"))}
    return owned_sums(placed, customers, sums, ("days_bin", "amount_bin")).select(
        "days_bin", "amount_bin", "n", (F.col("owed").cast("double") / 100).alias("outstanding")
    )


def value_histogram(
    df: DataFrame, column: str, low: float, high: float, bins: int, owners: DataFrame | None = None
) -> DataFrame:
    """Rows per bin of equal width; with ``owners`` only the rows of those customers."""
    width = (high - low) / bins
    placed = df.where(F.col(column).isNotNull()).withColumn("bin", x.histogram_bin(column, low, high, bins))
    counted = counts(placed, "bin") if owners is None else owned_sums(placed, owners, {"n": F.count(F.lit(1))}, ("bin",))
    return counted.select(
        "bin",
        (F.lit(low) + F.col("bin") * width).alias("from_value"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("to_value"),
        "n",
    )
