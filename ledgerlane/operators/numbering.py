"""Numbers within a key for keys of any size: sorted ranges, what a range holds of a key, offsets added."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.session import ensure_checkpoint_dir


def number_within(df: DataFrame, key: str, order: list[str], name: str = "position") -> DataFrame:
    """The rows with their number from 1 within ``key`` along ``order``, which must not leave ties open.

    The rows are dealt into sorted ranges by key and order, so a key with a third of all rows fills ranges of its own
    instead of one task, and are fixed in the checkpoint folder. Per key and range one small row says where the key
    begins in it and how many rows of the key lie in the ranges before. Rows with a null key are numbered like any other.
    """
    ensure_checkpoint_dir(df.sparkSession)
    sorted_rows = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    fixed = sorted_rows.checkpoint().withColumns(
        {
            "__range": F.spark_partition_id(),
            "__row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    held = fixed.groupBy(key, "__range").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(
        F.col(key).alias("__key"), F.col("__range").alias("__of"),
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__offset"),
    )
    same = fixed[key].eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__of"))
    return fixed.join(offsets, same).select(*df.columns, (F.col("__row") + F.col("__offset")).alias(name))
