"""Hierarchical weighted hash tree: documents descend regions, racks and shards by weighted hash draws.

At each level every child draws -ln(u) / weight from a hash of the document and the child's name; the smallest draw wins.
A child whose weight grows wins more documents and nothing moves between the others; inside a subtree whose children keep
their weights every document keeps its place. Shards are numbered into racks and racks into regions, so a new shard that
opens a region takes documents only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import text_or_empty

SHARDS_A_RACK = 2
RACKS_A_REGION = 2
#: Hash buckets of a shard for numbering its rows; a bucket is what one task sorts.
SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Leaf:
    shard: int
    rack: str
    region: str
    weight: float = 1.0


def even_tree(shards: int) -> list[Leaf]:
    """Shards in racks of two and regions of two racks, all of one weight."""
    if shards < 1:
        raise ValueError("a tree needs a shard")
    racks = [s // SHARDS_A_RACK for s in range(shards)]
    return [Leaf(s, f"rack{r}", f"region{r // RACKS_A_REGION}") for s, r in enumerate(racks)]


def draw(key: Column, node: str, weight: float) -> Column:
    """An exponential draw of the rate `weight`, fixed by key and node: 52 bits of an MD5 as a number within (0, 1)."""
    digest = F.md5(F.concat(key.cast("string"), F.lit("/" + node)))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(uniform) / F.lit(float(weight))


def choose(key: Column, children: Sequence[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest draw; equal draws go to the child named first."""
    if len(children) == 1:
        return children[0][2]
    draws = [
        F.struct(draw(key, name, weight).alias("draw"), F.lit(k).alias("k")) for k, (name, weight, _) in enumerate(children)
    ]
    winner = F.least(*draws).getField("k")
    chosen = children[-1][2]
    for k, (_, _, value) in enumerate(children[:-1]):
        chosen = F.when(winner == k, value).otherwise(chosen)
    return chosen


def descend(key: Column, tree: Sequence[Leaf]) -> Column:
    """The shard of a key: region, then rack, then shard."""
    regions: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in tree:
        if leaf.weight > 0:
            regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)

    def total(leaves: Sequence[Leaf]) -> float:
        return sum(leaf.weight for leaf in leaves)

    options = []
    for region, racks in regions.items():
        inside = [
            (f"{region}/{rack}", total(leaves), choose(key, [
                (f"{region}/{rack}/{leaf.shard}", leaf.weight, F.lit(leaf.shard)) for leaf in leaves
            ]))
            for rack, leaves in racks.items()
        ]
        options.append((region, sum(weight for _, weight, _ in inside), choose(key, inside)))
    return choose(key, options)


def assign(docs: DataFrame, tree: Sequence[Leaf], grown: Sequence[Leaf] | None = None, doc_id: str = "doc_id",
           text: str = "text", buckets: int = SLOT_BUCKETS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, with built-in functions only.

    shard follows from doc_id and the tree alone; grown_shard is the place in the tree `grown` (null without one). size
    counts the UTF-8 bytes of the text and one more, a null text has none and the CRC of an empty text. A null doc_id
    descends as the key "null". Repeated rows share a shard and get slots of their own. slot numbers the rows of a shard
    from 0 without gaps: rows are ordered inside hash buckets, whose counts give the offsets; the offsets are one row per
    shard and bucket, whatever the input. Only narrow columns are shuffled, never texts.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"),
    ).select(
        "*",
        F.lit("key").alias("law"),
        descend(key, tree).cast("int").alias("shard"),
        (descend(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
        F.pmod(F.hash("doc_id", "text_crc32", "size"), F.lit(buckets)).alias("bucket"),
    )
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # an array of (bucket, rows) per shard, at most `buckets` entries, turned into the rows before each bucket
    ahead = F.expr(
        "transform(b, x -> struct(x.bucket AS bucket, aggregate(filter(b, y -> y.bucket < x.bucket), 0L, (s, y) -> s + y.n) AS ahead))"
    )
    offsets = (
        counts.groupBy("shard").agg(F.collect_list(F.struct("bucket", "n")).alias("b"))
        .select("shard", F.explode(ahead).alias("o")).select("shard", "o.bucket", "o.ahead")
    )
    from pyspark.sql import Window

    order = Window.partitionBy("shard", "bucket").orderBy(
        F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")
    )
    numbered = rows.withColumn("place", F.row_number().over(order) - 1)
    return numbered.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("ahead") + F.col("place")).cast("long").alias("slot"),
        "grown_shard",
    )
