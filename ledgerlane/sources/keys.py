"""A key index beside a stored table: which values its unique columns hold, by bucket, and its largest id.

The index lies in ``_keys`` below the table, where readers of the table do not look. A log names the data files that it
covers. Before a check, files that the log does not name are read and added, and named last, so an append that failed
between the table and the index is made good by the next one; values added twice do no harm. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlane.sources.files import stored_rows

#: Hash buckets by which the index is ordered. An append that touches at most `NAMED` of them names them to the scan.
BUCKETS = 1024
NAMED = 64
VALUES = "value string, name string, bucket int"
FILES = "file string, max_id bigint"


def bucket_of(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


def keys_of(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, bucket, value) of every key that is not null, as text."""
    held = rows.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "name", "value")
    return held.where("value IS NOT NULL").select("value", "name", bucket_of(F.col("value")).alias("bucket"))


def cover(spark: SparkSession, path: str, schema: StructType, columns: Sequence[str]) -> int:
    """Bring the index of the table at ``path`` up to date; returns the largest id stored, 0 for none.

    Reads the list of files and those files only that are new to the index.
    """
    stored = stored_rows(spark, path, schema)
    if stored is None:
        return 0
    log = stored_rows(spark, f"{path}/_keys/files", FILES)
    known = log.collect() if log is not None else []
    new = sorted(set(stored.inputFiles()) - {r.file for r in known})
    largest = max((r.max_id for r in known if r.max_id is not None), default=0)
    if new:
        rows = spark.read.schema(schema).parquet(*new)
        if columns:
            # in order of column and bucket: a scan for some buckets skips all other pages
            held = keys_of(rows, columns).repartitionByRange("name", "bucket", "value")
            ordered = held.sortWithinPartitions("name", "bucket", "value")
            ordered.write.mode("append").parquet(f"{path}/_keys/values")
        added = rows.agg(F.max("id")).first()[0]
        named = spark.createDataFrame([(f, added) for f in new], FILES)
        named.coalesce(1).write.mode("append").parquet(f"{path}/_keys/files")
        largest = max(largest, added or 0)
    return largest


def held_values(spark: SparkSession, path: str, name: str, buckets: Sequence[int]) -> DataFrame | None:
    """The indexed values of a column in some buckets. The scan skips the pages of other buckets, as they are sorted."""
    index = stored_rows(spark, f"{path}/_keys/values", VALUES)
    if index is None or not buckets:
        return None
    named = index.where(F.col("name") == name)
    if len(buckets) <= NAMED:
        # single comparisons reach the scan one by one; a list of them would only give its ends
        named = named.where(reduce(or_, [F.col("bucket") == b for b in buckets]))
    return named.select("value")


def clashes(rows: DataFrame, path: str, name: str) -> DataFrame:
    """Values of ``name`` that come twice in ``rows``, or once more than the table at ``path`` holds them. Nulls never clash."""
    keys = keys_of(rows, [name])
    repeated = keys.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("value")
    # at most BUCKETS numbers
    buckets = [r.bucket for r in keys.select("bucket").distinct().collect()]
    held = held_values(rows.sparkSession, path, name, buckets)
    return repeated if held is None else repeated.union(keys.join(held, "value", "left_semi").select("value"))
