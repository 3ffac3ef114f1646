"""What the tables hold: columns, row counts, a profile per column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane.sources.schemas import DDL, table_schema


def table_names() -> list[str]:
    return list(DDL)


def table_columns(table: str) -> list[dict]:
    """Declared columns: name, type, whether NULL is allowed, whether it is the key."""
    return [
        {"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable, "primary_key": f.name == "id"}
        for f in table_schema(table)
    ]


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, all counted by one job."""
    return reduce(
        DataFrame.unionByName,
        [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t, df in tables.items()],
    )


def column_profile(df: DataFrame, table: str, approximate: bool = False) -> DataFrame:
    """Rows, NULLs and distinct values per column, from one scan.

    For exact counts a row becomes one (column, value) row per column, which each task reduces
    to its different values before anything moves; values travel as digests where they are text.
    ``approximate`` keeps a fixed-size sketch per column instead.
    """
    if approximate:
        row = df.agg(
            *[
                F.struct(
                    F.count(F.lit(1)).alias("n_rows"),
                    F.count_if(F.col(c).isNull()).alias("n_null"),
                    F.approx_count_distinct(F.col(c)).alias("n_distinct"),
                ).alias(c)
                for c in df.columns
            ]
        )
        return row.unpivot([], df.columns, "column_name", "p").select(
            F.lit(table).alias("table_name"), "column_name", "p.n_rows", "p.n_null", "p.n_distinct"
        )
    kinds = {f.name: f.dataType for f in df.schema}
    held = [
        F.when(F.length(c) > 32, F.md5(c)).otherwise(F.col(c)).alias(c)
        if isinstance(kinds[c], T.StringType)
        # adding zero makes -0.0 and 0.0 one value
        else (F.col(c) + F.lit(0.0) if isinstance(kinds[c], (T.FloatType, T.DoubleType)) else F.col(c)).cast("string").alias(c)
        for c in df.columns
    ]
    values = df.select(*held).unpivot([], df.columns, "column_name", "value")
    reduced = values.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    # a table without rows still has columns
    empty = [(c, None, 0) for c in df.columns]
    reduced = reduced.union(df.sparkSession.createDataFrame(empty, "column_name string, value string, n bigint"))
    return reduced.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.count("value").alias("n_distinct"),
    ).select(F.lit(table).alias("table_name"), "column_name", "n_rows", "n_null", "n_distinct")


#: Bits of a sketch; its standard error is about 1.04 / sqrt(2 ** bits), under one percent.
SKETCH_BITS = 14


def profile_sketch(df: DataFrame, table: str) -> DataFrame:
    """One row per column that stands for a load: rows, NULLs and a sketch of the values, of fixed size."""
    row = df.agg(
        *[
            F.struct(
                F.count(F.lit(1)).alias("n_rows"),
                F.count_if(F.col(c).isNull()).alias("n_null"),
                F.hll_sketch_agg(F.col(c).cast("string"), SKETCH_BITS).alias("sketch"),
            ).alias(c)
            for c in df.columns
        ]
    )
    return row.unpivot([], df.columns, "column_name", "p").select(
        F.lit(table).alias("table_name"), "column_name", "p.n_rows", "p.n_null", "p.sketch"
    )


def united_profile(sketches: DataFrame) -> DataFrame:
    """The profile of all loads together from their stored sketches alone; distinct values are estimates."""
    return sketches.groupBy("table_name", "column_name").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_null").alias("n_null"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"),
    )


def column_profiles(tables: dict[str, DataFrame], approximate: bool = False) -> DataFrame:
    return reduce(DataFrame.unionByName, [column_profile(df, t, approximate) for t, df in tables.items()])
