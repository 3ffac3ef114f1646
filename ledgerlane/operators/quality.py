"""Audits of the declared constraints, defaults on ingest, and surrogate ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.session import ensure_checkpoint_dir
from ledgerlane.sources.schemas import DEFAULTS


def _one_row_per_column(df: DataFrame, table: str, measures: dict[str, Column], name: str) -> DataFrame:
    """One pass over ``df`` computing every measure, then one output row per column."""
    totals = df.agg(*[m.alias(c) for c, m in measures.items()])
    return totals.unpivot([], list(measures), "column_name", name).select(
        F.lit(table).alias("table_name"), "column_name", name
    )


def enum_violations(df: DataFrame, table: str, domains: dict[str, list[str]]) -> DataFrame:
    """Rows outside the allowed values, per column. NULL passes, as in a SQL CHECK."""
    checks = {c: F.count_if(~F.col(c).isin(allowed)) for c, allowed in domains.items()}
    return _one_row_per_column(df, table, checks, "n_bad")


def null_violations(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    checks = {c: F.count_if(F.col(c).isNull()) for c in columns}
    return _one_row_per_column(df, table, checks, "n_null")


def range_violations(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.where(~F.col(column).between(low, high))


def duplicate_values(df: DataFrame, column: str) -> DataFrame:
    """Values held by more than one row. NULLs do not clash with each other."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where("n_rows > 1")
    )


def orphan_keys(children: dict[str, DataFrame], parents: DataFrame, fk: str = "customer_id") -> DataFrame:
    """Child rows and distinct child keys without a parent, per child table.

    Children are counted per key before the join, so a key that fills a third of
    a table crosses the network as a few rows.
    """
    keys = reduce(
        DataFrame.unionByName,
        [df.where(F.col(fk).isNotNull()).select(F.lit(t).alias("table_name"), fk) for t, df in children.items()],
    )
    counted = keys.groupBy("table_name", fk).agg(F.count(F.lit(1)).alias("n"))
    known = parents.select(F.col("id").alias("parent_id"))
    missing = F.col("parent_id").isNull()
    return (
        counted.join(known, F.col(fk) == F.col("parent_id"), "left")
        .groupBy("table_name")
        .agg(
            F.sum(F.when(missing, F.col("n")).otherwise(0)).alias("n_orphans"),
            F.count_if(missing).alias("n_orphan_keys"),
        )
    )


def apply_defaults(df: DataFrame, table: str, now: Column | None = None) -> DataFrame:
    """Fill columns that the input leaves out; a NULL that is present stays NULL."""
    stamp = F.current_timestamp() if now is None else now
    defaults = {c: F.lit(v) for c, v in DEFAULTS.get(table, {}).items()}
    defaults["created_at"] = stamp.cast("timestamp_ntz")
    if table in ("customers", "collections"):
        defaults["updated_at"] = stamp.cast("timestamp_ntz")
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def assign_ids(df: DataFrame, after: int = 0, column: str = "id") -> DataFrame:
    """Number the rows after + 1, after + 2, ... without gaps.

    The input is written to the checkpoint folder first, so both passes see the
    same partitions even if an executor is lost in between. Only the row count of
    each partition is gathered and broadcast: one small row per partition.
    """
    ensure_checkpoint_dir(df.sparkSession)
    fixed = df.checkpoint()
    numbered = fixed.withColumns(
        {
            "__part": F.spark_partition_id(),
            "__row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    counts = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return numbered.join(F.broadcast(offsets), "__part").select(
        (F.lit(after) + F.col("__before") + F.col("__row") + 1).alias(column),
        *[c for c in df.columns if c != column],
    )
