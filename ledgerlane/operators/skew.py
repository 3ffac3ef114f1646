"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = 1024


def join_splitting_hot_keys(
    facts: DataFrame, dim: DataFrame, key: str, how: str, spread: str, pieces: int = PIECES
) -> DataFrame:
    """Join facts to a table on ``key``, cutting hot keys into pieces by a hash of ``spread``.

    Adaptive execution splits skewed partitions only where both sides arrive straight
    from a shuffle. This does it where the other side is the result of earlier joins or
    aggregates. Rows per key are counted first; a key is hot if it holds more than one
    ``pieces``-th of all rows, so there are fewer than ``pieces`` hot keys and their list
    is safe to broadcast. Only hot keys are repeated on the other side, once per piece.
    ``facts`` is read twice, so it should be a table and not a long chain of steps.
    """
    sizes = facts.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # the same aggregate gives the total, so its shuffle is reused
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    hot = F.broadcast(
        sizes.where(F.col(key).isNotNull() & (F.col("n") * pieces > total)).select(
            F.col(key).alias("hot_key"), F.ceil(F.col("n") * pieces / total).cast("int").alias("cuts")
        )
    )
    is_hot = F.col(key) == F.col("hot_key")
    # Rows without a key match nothing; they are spread over all pieces.
    cuts = F.when(F.col(key).isNull(), pieces).otherwise(F.coalesce("cuts", F.lit(1)))
    piece = F.pmod(F.xxhash64(spread), cuts.cast("bigint")).cast("int")
    left = facts.join(hot, is_hot, "left").withColumn("piece", piece).drop("hot_key", "cuts")
    right = (
        dim.join(hot, is_hot, "left")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1)))
        .drop("hot_key", "cuts")
    )
    return left.join(right, [key, "piece"], how).drop("piece")
