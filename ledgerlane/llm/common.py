"""Helpers that several operators share: shared folders, document columns, connected components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.operators.skew import join_splitting_hot_keys
from ledgerlane.session import ensure_checkpoint_dir


def reachable(spark: SparkSession) -> None:
    """On one machine, let Python workers find this package where the driver has it.

    On a cluster the package comes with the job (--py-files or an image), as for any library.
    """
    context = spark.sparkContext
    root = str(Path(__file__).resolve().parents[2])
    held = context.environment.get("PYTHONPATH", "")
    if context.master.startswith("local") and root not in held.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(p for p in (held, root) if p)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, lost executors lose nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query shuffled goes from the disk when the query ends, not when the driver collects garbage.

    For queries that run once, as those that write a table.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def by_id(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in columns]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges (a, b) of longs.

    Each round alternates the two star operations of Kiveris et al. (2014): every node links its larger neighbours to
    its smallest one, then its smaller neighbours likewise. The edge set never grows beyond one row per edge, each
    round is a reduction with map-side combine, and the edges of a node with more than 1/1024 of them are cut into pieces
    before they meet its smallest neighbour, so a node with a third of all edges is spread over many tasks. Nodes
    without an edge do not appear. Lineage is cut in the shared checkpoint folder. Rows with a null end and loops are
    no links. Raises if `rounds` do not suffice (diameters halve, so 60 rounds stand for any real graph).
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    low, high = F.least("a", "b"), F.greatest("a", "b")
    current = (
        edges.where(F.col("a") != F.col("b")).select(low.alias("a"), high.alias("b")).distinct().checkpoint(eager=True)
    )
    for _ in range(rounds):
        # large star: of every node, the larger neighbours move to the smallest of the node and its neighbours
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            # the smaller end is always `a`, so these are the edges to larger neighbours
            join_splitting_hot_keys(current, least, "a", "inner", spread="b")
            .select(F.col("m").alias("a"), "b").where(F.col("a") != F.col("b")).distinct().checkpoint(eager=True)
        )
        # small star: of every node, the smaller neighbours and the node itself move to the smallest one
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        ends = F.explode(F.array("a", "b")).alias("b")
        small = (
            join_splitting_hot_keys(large, least, "b", "inner", spread="a")
            .select(F.col("m").alias("a"), ends)
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        following = small.checkpoint(eager=True)
        # a forest of stars is stable: no node is the larger end twice, and no centre is the larger end
        unstable = (
            following.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("b")
            .union(following.select("a").distinct().join(following.select(F.col("b").alias("a")).distinct(), "a", "left_semi"))
        )
        current = following
        if unstable.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    centres = current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).union(centres)
