"""Bounded samples of labelled documents for the classifiers; the only rows that ever reach the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(divisor: int, doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text modulo `divisor`; a null id counts as an empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % divisor


def hashed_sample(docs: DataFrame, bound: int, text: str = "text") -> DataFrame:
    """(at, text) of at most `bound` different texts, those first by a hash; only the hashes are sorted.

    The chosen hashes go to every executor, `bound` numbers; copies of a text meet as one row per task.
    """
    rows = docs.select(F.xxhash64(text).alias("at"), F.col(text).alias("text"))
    chosen = rows.groupBy("at").agg(F.lit(1).alias("one")).select("at").orderBy("at").limit(bound)
    return rows.join(F.broadcast(chosen), "at").groupBy("at").agg(F.min("text").alias("text"))


def sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, bounds: dict[int, int]) -> pd.DataFrame:
    """(text, label) of at most `bounds[value]` documents per label value, those first by a hash of the id.

    `learnable` is a condition on doc_id. Labels that are null or contradict each other are left out, a document that
    appears with several texts gives its smallest one. Texts are whole. Sorted by text, so every run sees one order.
    """
    clean = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .where(learnable)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("doc_id", "label")
    )
    chosen = None
    for value, bound in bounds.items():
        part = clean.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    # at most the sum of the bounds, so it may go to every executor
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return found.select("text", "label").toPandas().sort_values(["text", "label"], ignore_index=True)
