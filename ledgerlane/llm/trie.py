"""The prefix trie of conversations, built by peeling the last turn off, from the deepest shared depth up to the root.

1. `ordered` numbers the turns of every conversation; a turn is carried as its SHA-256 and its length, never as text.
2. `slices` gives every turn the key of the prefix that ends with it: the XOR of 128-bit hashes of (position, turn) up to
   there. Prefix and parent differ by one such hash, so the keys come from sums over chunks of turns, and a conversation
   with a third of all turns is cut into chunks.
3. `nodes` peels. A round takes one depth: conversations that end there meet the nodes that survived from one turn deeper,
   both are grouped by key, and that aggregate already is the node. Its last turn is then stripped, which gives the key
   for the next round. Counts, leaves, savings and smallest members are sums and minima with map-side combine, so the root
   or a prefix of a third of all conversations costs one row per task. Prefixes deeper than any shared one have a single
   member; all of them are written in the first step, so rounds are as many as the deepest shared depth.

Every round ends in a table in the shared folder: lost executors cost one round at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.llm.common import reachable, scratch, text_or_empty, written
from ledgerlane.operators.skew import join_splitting_hot_keys

#: Turns in a chunk of a conversation, and conversation ids in a block of a node's ends.
CHUNK = 1024
ENDS = 10  # bits
#: The key of the textless root.
ROOT = "0" * 32


def along(
    rows: DataFrame, chunk: Column, order: list[Column], measures: dict[str, tuple[Column, Callable, Callable]]
) -> DataFrame:
    """Running measures within each conversation, from windows over chunks and one row per chunk before them.

    A measure is (aggregate, the aggregate of such aggregates, how two of them unite). ``chunk`` must not decrease along
    ``order``. Adds the measures under their names.
    """
    fine = Window.partitionBy("conv_id", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    coarse = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("chunk", chunk)
    totals = marked.groupBy("conv_id", "chunk").agg(*[m.alias(n) for n, (m, _, _) in measures.items()])
    before = totals.select(
        "conv_id", "chunk", *[F.coalesce(fold(n).over(coarse), F.lit(0)).alias(f"{n}_before") for n, (_, fold, _) in measures.items()]
    )
    inside = marked.select("*", *[m.over(fine).alias(f"{n}_inside") for n, (m, _, _) in measures.items()])
    return inside.join(before, ["conv_id", "chunk"]).select(
        *rows.columns, *[unite(F.col(f"{n}_inside"), F.col(f"{n}_before")).alias(n) for n, (_, _, unite) in measures.items()]
    )


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_sha, size): every turn with its number from 1, its SHA-256 and the code points of its text.

    Turns are ordered by ``turn``, null first; turns of equal number by their digest. Null roles and texts are empty.
    Rows without a conv_id belong to no conversation. Repeated rows are turns of their own.
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256).alias("turn_sha"),
        F.char_length(text).cast("long").alias("size"),
    )
    chunk = F.shiftright(F.coalesce("turn", F.lit(-(1 << 63)).cast("long")), 10)
    order = [F.col("turn").asc_nulls_first(), F.col("turn_sha")]
    counted = along(turns, chunk, order, {"pos": (F.count(F.lit(1)), F.sum, lambda a, b: a + b)})
    return counted.select("conv_id", "pos", "turn_sha", "size")


def lengths(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of every conversation."""
    return turns.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))


def with_borrowed_heads(turns: DataFrame, block: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of the first conversation of their block of ids; turns and lengths.

    The first h = crc32(decimal conv_id) % (most + 1) turns are taken from conversation c - c % block, all of them if it
    has fewer, none if it is absent; the conversation's own turns follow after its first h.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    heads = (
        turns.where((F.col("conv_id") % block == 0) & (F.col("pos") <= most))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.collect_list(F.struct("pos", "turn_sha", "size")).alias("head"))
    )
    base = lengths(turns).withColumnsRenamed({"n_turns": "own"}).withColumn("base", F.expr(f"conv_id - conv_id % {block}"))
    none = F.array().cast("array<struct<pos:bigint,turn_sha:string,size:bigint>>")
    held = base.join(heads, "base", "left").withColumn("h", h)
    taken = F.filter(F.coalesce("head", none), lambda t: t["pos"] <= F.col("h"))
    conversations = written(
        held.select("conv_id", "h", "own", taken.alias("taken")).withColumn(
            "n_turns", F.size("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
        ),
        "conversations",
    )
    borrowed = conversations.select("conv_id", F.explode("taken").alias("t")).select("conv_id", "t.*")
    kept = turns.join(conversations.select("conv_id", "h", F.size("taken").alias("n_taken")), "conv_id")
    own = kept.where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("n_taken")).alias("pos"), "turn_sha", "size")
    return borrowed.unionByName(own), conversations.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"))


def slices(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent_key, size, n_turns) of every turn, each file in order of depth."""

    def xored(column: str) -> tuple[Column, Callable, Callable]:
        return F.bit_xor(column), F.bit_xor, lambda a, b: a.bitwiseXOR(b)

    hashed = turns.withColumnsRenamed({"pos": "depth"}).withColumns(
        {"high": F.xxhash64("depth", "turn_sha"), "low": F.xxhash64("turn_sha", "depth")}
    )
    chunk = F.shiftright(F.col("depth"), 10)
    keyed = along(hashed, chunk, [F.col("depth")], {"high_sum": xored("high"), "low_sum": xored("low")})

    def key(high: Column, low: Column) -> Column:
        return F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0"))

    return written(
        keyed.join(conversations, "conv_id")
        .select(
            "conv_id", "depth", key(F.col("high_sum"), F.col("low_sum")).alias("key"),
            key(F.col("high_sum").bitwiseXOR(F.col("high")), F.col("low_sum").bitwiseXOR(F.col("low"))).alias("parent_key"),
            "size", "n_turns",
        )
        .sortWithinPartitions("depth"),
        "slices",
    )


MEMBERS = ["key", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def _one(key: str, **values: int) -> list[Column]:
    """A contribution of a single conversation to a node."""
    given = {"n_convs": 1, "n_children": 0, "n_leaves": 0, "saved_tokens": 0} | values
    return [F.col(key).alias("key"), "conv_id", *[F.lit(v).cast("long").alias(n) for n, v in given.items()]]


def _merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in MEMBERS[2:]]
    ).withColumn("n_leaves", F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves")))


def peeled(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Every node: depth, key, parent_key and the members of ``MEMBERS``, from the deepest shared depth upwards."""
    spark = rows.sparkSession
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth")).where("n > 1")
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    folder = scratch(spark, "nodes")
    # deeper than any shared prefix: every prefix has one member
    lonely = rows.where(F.col("depth") > deepest).select(
        *_one("key", n_leaves=1), "depth", "parent_key", (F.col("depth") < F.col("n_turns")).cast("long").alias("goes_on")
    ).withColumn("n_children", F.col("goes_on")).drop("goes_on")
    survivors = rows.where(F.col("depth") == deepest + 1).select(*_one("parent_key", n_children=1, n_leaves=1))
    schema = None
    for depth in range(deepest, 0, -1):
        here = rows.where(F.col("depth") == depth)
        ended = here.where(F.col("n_turns") == depth).select(*_one("key"))
        node = (
            _merged(ended.unionByName(survivors))
            .join(here.select("conv_id", "parent_key", "size"), "conv_id")
            .withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size"))
            .select(*MEMBERS, "parent_key")
        )
        node.write.parquet(f"{folder}/depth={depth}")
        schema = node.schema
        node = spark.read.schema(schema).parquet(f"{folder}/depth={depth}")
        survivors = node.select(
            F.col("parent_key").alias("key"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"),
            "n_leaves", "saved_tokens",
        )
    turnless = conversations.where("n_turns = 0").withColumn("root", F.lit(ROOT)).select(*_one("root"))
    root = _merged(turnless.unionByName(survivors.withColumn("key", F.lit(ROOT))))
    root.withColumn("parent_key", F.lit(None).cast("string")).write.parquet(f"{folder}/depth=0")
    shared_nodes = spark.read.schema(f"{', '.join(f'{c} ' + ('string' if c == 'key' else 'long') for c in MEMBERS)},"
                                     " parent_key string, depth long").parquet(folder)  # fmt: skip
    return shared_nodes.unionByName(lonely.select(*MEMBERS, "parent_key", "depth"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One digest per key from its blocks in order; only the block in hand is held."""
    key = running = None
    for batch in batches:
        done = []
        for k, ids in zip(batch["key"], batch["ids"]):
            if k == key:
                running.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((key, running.hexdigest()))
            key, running = k, hashlib.sha256(ids.encode())
        yield pd.DataFrame(done, columns=["key", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(key, running.hexdigest())], columns=["key", "ends_sha256"])


def ends(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """(key, ends_sha256): digest of the ids of the conversations that end at a node, ascending, joined by commas.

    Ids are joined per block of 1,024 first; the blocks of a node are then hashed one after the other in a stream, as a
    digest of a list cannot be united from parts. A node where a third of all conversations end costs few, bounded rows.
    """
    reachable(rows.sparkSession)
    ended = rows.where(F.col("n_turns") == F.col("depth")).select("key", "conv_id")
    turnless = conversations.where("n_turns = 0").select(F.lit(ROOT).alias("key"), "conv_id")
    blocks = (
        ended.unionByName(turnless)
        .groupBy("key", F.shiftright(F.col("conv_id"), ENDS).alias("block"))
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    )
    return blocks.repartition("key").sortWithinPartitions("key", "block").mapInPandas(_digests, "key string, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    ``turns`` are those of `ordered`, ``conversations`` their lengths, turnless ones included. Without conversations there
    is no node, not even the root. Equal conversations share all their nodes. Saved tokens are the code points that the
    members of a subtree need not hold again. Texts of any length count whole, through their digest.
    """
    turns = written(turns, "turns")
    rows = slices(turns, conversations)
    nodes = peeled(rows, conversations)
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")).where(
        F.col("n_children") > 0
    )
    below = nodes.where("parent_key IS NOT NULL")
    linked = join_splitting_hot_keys(below, parents, "parent_key", "inner", "conv_id").unionByName(
        nodes.where("parent_key IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    )
    return linked.join(ends(rows, conversations), "key", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of a table of turns as it is."""
    turns = written(ordered(conversations), "turns")
    return trie(turns, lengths(turns))
