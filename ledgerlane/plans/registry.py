"""Named queries over the lending tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane.sources.views import Lending

QUERIES: dict[str, Callable[[Lending], DataFrame]] = {}


def query(function: Callable[[Lending], DataFrame]) -> Callable[[Lending], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def iso_dates(df: DataFrame) -> DataFrame:
    """Dates and times as ISO text, the form in which reports show them."""
    dated = (T.DateType, T.TimestampType, T.TimestampNTZType)
    columns = {f.name: F.col(f.name).cast("string") for f in df.schema if isinstance(f.dataType, dated)}
    return df.withColumns(columns) if columns else df


def run(name: str, spark: SparkSession, root: str) -> DataFrame:
    return iso_dates(QUERIES[name](Lending(spark, root)))
