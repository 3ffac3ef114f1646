"""The corpus pipeline: toxicity, near-duplicates, decontamination, personal data, tokens.

Every stage takes all its predecessor kept, whatever further columns the table has; all but the last return its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm import bpe, decontamination, pii, simhash, toxicity
from ledgerlane.llm.common import reachable, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine scores at the threshold or above go; null and empty texts stay."""
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels"), toxicity.learnable())
    return docs.where(toxicity.scores(machine) < toxicity.THRESHOLD)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: the one with the smallest id, of equal rows any one.

    Rows without an id stay unless the group has one; of those with one fingerprint a single row stays.
    """
    found = simhash.near_duplicates(docs, width=3, max_bits=2)
    gone = found.where("component_id IS NOT NULL AND NOT doc_id <=> component_id")
    # ids and fingerprints that come several times; most tables have none
    again = found.groupBy("doc_id", "simhash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    doubtful = gone.select("doc_id").union(again).distinct().select(F.col("doc_id").alias("doubtful"))
    same = docs["doc_id"].eqNullSafe(doubtful["doubtful"])
    certain = docs.join(doubtful, same, "left_anti")
    name = "fingerprint of this stage"
    checked = simhash.fingerprints(docs.join(doubtful, same, "left_semi"), name=name)
    out = gone.select(F.col("doc_id").alias("gone"), F.col("simhash").alias("gone_print")).distinct()
    kept = checked.join(
        out, checked["doc_id"].eqNullSafe(out["gone"]) & (checked[name] == out["gone_print"]), "left_anti"
    ).dropDuplicates(["doc_id", name])
    return certain.unionByName(kept.drop(name))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    found = decontamination.contained(docs, table(spark, sf_dir, "benchmark"))
    return docs.where(F.size(found["items"]) == 0)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kinds; n_chars, where there is one, follows the text."""
    redacted = F.when(F.col("text").isNotNull(), pii.spans(docs)["redacted"])
    out = docs.withColumn("text", redacted)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the token ids and of the text they decode to."""
    reachable(spark)
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("pii", redact_private),
    ("bpe", tokens),
]

#: No SQL: classifier, fingerprints, latent space, field and merges cannot be written in it. Tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
