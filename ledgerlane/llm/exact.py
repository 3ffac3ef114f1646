"""Exact duplicates: frequent digests are found by a Misra-Gries summary and settled on the map side, the rest by shuffling.

1. One pass over the texts leaves a narrow table of digests in the shared folder; everything later reads that table.
2. Spark's frequent-items sketch (a Misra-Gries summary with 64-bit items) is built per task, united in a fixed number of
   groups and then once more, so no task reads more than the groups' sketches. It counts within `TRACKED` counters; an
   item in over one in `SHARE` of all rows is among the `CANDIDATES` largest, as their estimates cannot sum to more.
3. The candidates' rows are counted exactly, by whole digest. Those that are truly in over one in `SHARE` rows are the
   verified winners: under `SHARE` rows, which is what makes their broadcast safe. Their documents are settled by that
   broadcast alone and never shuffled.
4. The other digests, each in at most one in `SHARE` rows, are shuffled by digest and settled in a window.

What the summary says is only a hint: a wrong or missing candidate changes the route of a digest, not the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.llm.common import text_or_empty, written

#: The characters that do not count: the space and U+0009 to U+000D.
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
#: A digest in over one in so many rows is a heavy hitter.
SHARE = 1024
#: Counters of a summary, and the items asked of it. The summary errs by at most 3.5 / 16384 of all rows, so every item
#: in over N / 1024 rows has an estimate that under 2048 items can reach.
TRACKED = 8192
CANDIDATES = 2048
#: Groups in which the summaries of tasks are united first.
UNITED = 256


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a text without its blank characters; null counts as empty."""
    return F.sha2(F.translate(text, BLANK, ""), 256)


def digests(docs: DataFrame) -> DataFrame:
    """One narrow row per document: id, digest, code points, a hash of the whole text, and a number of the row."""
    text = text_or_empty()
    return written(
        docs.select(
            "doc_id",
            digest(text).alias("text_sha256"),
            F.char_length(text).alias("n_chars"),
            F.xxhash64(text).alias("whole"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )


def frequent(rows: DataFrame) -> DataFrame:
    """(item): 64-bit hashes of the digests that may be heavy hitters, at most `CANDIDATES`."""
    hashed = rows.select(F.xxhash64("text_sha256").alias("item"), (F.spark_partition_id() % UNITED).alias("united"))
    by_group = hashed.groupBy("united").agg(F.expr(f"approx_top_k_accumulate(item, {TRACKED})").alias("summary"))
    # grouped by a constant: a table without rows has no group, and no summary to unite
    whole = by_group.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(summary, {TRACKED})").alias("summary"))
    items = F.expr(f"approx_top_k_estimate(summary, {CANDIDATES})")
    return whole.select(F.explode(items).alias("found")).select("found.item")


def _best() -> Column:
    """Orders the rows of a group: most code points, smallest id, nulls last; of equal ones the hash and the row decide."""
    return F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "whole", "row")


def winners(rows: DataFrame) -> DataFrame:
    """The heavy hitters with their exact size and the row that stays; under `SHARE` rows."""
    total = rows.count()
    candidates = F.broadcast(frequent(rows))
    counted = (
        rows.join(candidates, F.xxhash64("text_sha256") == F.col("item"), "left_semi")
        .groupBy("text_sha256")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(_best()).alias("best"))
    )
    heavy = counted.where((F.col("group_size") > 1) & (F.col("group_size") * SHARE > total))
    return written(heavy.select(F.col("text_sha256").alias("heavy"), "group_size", "best"), "heavy")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, dropped ones too.

    Texts are equal when they are identical without their blank characters (compared by SHA-256); null counts as empty.
    Of equal texts the row with most code points, then the smallest id stays; a null id comes after all others, and of
    rows that agree in id and length exactly one is kept, so repeated rows are dropped like any copy. Texts of any length
    are hashed whole. An empty table gives an empty result; further columns are not read, so their names cannot clash.
    """
    rows = digests(docs)
    heavy = F.broadcast(winners(rows))
    is_heavy = F.col("text_sha256") == F.col("heavy")
    group = Window.partitionBy("text_sha256")
    settled = rows.join(heavy, is_heavy)
    others = rows.join(heavy, is_heavy, "left_anti").select(
        "*", F.count(F.lit(1)).over(group).alias("group_size"), F.min(_best()).over(group).alias("best")
    )
    columns = [
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    ]
    return settled.select(*columns).unionAll(others.select(*columns))


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = groups(docs).where("kept").select(F.col("doc_id").alias("kept id"), F.col("text_sha256").alias("kept digest"))
    same = docs["doc_id"].eqNullSafe(kept["kept id"]) & (digest(text_or_empty(docs["text"])) == kept["kept digest"])
    found = docs.join(kept, same, "left_semi")
    # rows that repeat an id and a text up to blanks: the longest stays, as in `groups`
    order = Window.partitionBy("doc_id", digest(text_or_empty("text"))).orderBy(
        F.desc(F.char_length(text_or_empty("text"))), F.xxhash64(text_or_empty("text"))
    )
    name = "rank of this row"
    return found.withColumn(name, F.row_number().over(order)).where(F.col(f"`{name}`") == 1).drop(name)
