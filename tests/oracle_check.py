"""Compare query results between Spark and DuckDB, order aside."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

SOURCES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
           " conversations").split()  # fmt: skip


def connect(root: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in SOURCES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{root}/{table}.parquet')")
    return connection


def family(value) -> str:
    """Kind of value: engines may differ in width but not in kind."""
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, (float, decimal.Decimal)):
        return "real"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return "time"
    return type(value).__name__


def canonical(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(value):
        if isinstance(value, float):
            return 0.0 if value == 0 else float(f"{value:.12g}") if math.isfinite(value) else str(value)
        return value

    return sorted((tuple(cell(row[i]) for i in order) for row in rows), key=repr)


def difference(spark_df, connection, sql: str) -> str | None:
    """None if equal, else the first thing that differs."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    got = [tuple(row) for row in spark_df.collect()]
    if len(got) != len(expected):
        return f"rows {len(got)} != {len(expected)}"
    left, right = canonical(spark_df.columns, got), canonical(names, expected)
    for a, b in zip(left, right):
        if a != b:
            return f"{a} != {b}"
        kinds = [(x, y) for x, y in zip(a, b) if x is not None and family(x) != family(y)]
        if kinds:
            return f"kinds {kinds} in columns {sorted(names)}"
    return None
