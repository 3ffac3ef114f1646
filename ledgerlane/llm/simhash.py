"""SimHash near-duplicates over an inverted index of positional bytes with count filtering.

Fingerprints at most two bits apart differ in at most two of their eight bytes, so they share at least six positional
bytes. The index holds every fingerprint under eleven postings of five positional bytes each, chosen so that any two
missing positions leave one posting whole. Inside a posting only the other three bytes can differ. The fingerprints of a
small posting meet in pairs, at most as many rows as entries would be. In a larger one every fingerprint is entered
under its rest and under the rest with each single bit turned, and meets the others at a common entry. Each
entry links its members to its smallest one, so a posting of any size costs rows in proportion to its members, and
chains over the entries join whatever is within two bits. The linked pairs are then counted over all eight
positions, kept from six shared bytes on, and verified by their bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerlane.llm.common import components, text_or_empty, written

SEED = 42
BITS = 64
BYTES = 8
#: Fingerprints of a posting up to which they meet in pairs: at most 15.5 rows for each, where entries are 25.
PAIRED = 32
WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint_of(text: str, width: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer; zero for a text without words."""
    words = WORDS.findall(text.encode("utf-8", "surrogatepass").translate(LOWER))
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(width)))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        block = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, name: str = "simhash") -> DataFrame:
    """Adds the column `name` (signed long; an earlier one is replaced). A null text counts as empty: zero."""

    @pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint_of(t, width) for t in batch], dtype="int64")

    return docs.withColumn(name, run(text_or_empty(text)))


def covering(missing: int) -> list[tuple[int, ...]]:
    """Position sets to leave out, three or more each, so that any `missing` positions lie inside one of them.

    Picks greedily among all sets of one size; small numbers, fixed order, so the same everywhere.
    """
    size = min(BYTES, missing + 1)
    open_sets = set(combinations(range(BYTES), missing))
    chosen: list[tuple[int, ...]] = []
    while open_sets:
        best = max(
            combinations(range(BYTES), size),
            key=lambda c: (len(open_sets & set(combinations(c, missing))), [-x for x in c]),
        )
        open_sets -= set(combinations(best, missing))
        chosen.append(best)
    return chosen


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes two fingerprints share."""
    differing = a.bitwiseXOR(b)
    total = F.lit(0)
    for k in range(BYTES):
        total = total + F.when(F.shiftrightunsigned(differing, 8 * k).bitwiseAND(F.lit(0xFF)) == 0, 1).otherwise(0)
    return total


def postings(prints: DataFrame, max_bits: int) -> DataFrame:
    """(simhash, posting, key, n): every posting of each different fingerprint that it shares with others, n in all."""
    distinct = prints.where(F.col("simhash").isNotNull()).select("simhash").distinct()
    posting = F.explode(
        F.array(*[
            F.struct(F.lit(n).alias("posting"), F.col("simhash").bitwiseAND(F.lit(~m)).alias("key"))
            for n, m in enumerate(signed(sum(0xFF << (8 * k) for k in rest)) for rest in covering(max_bits))
        ])
    )
    index = distinct.select("simhash", posting.alias("p")).select("simhash", "p.posting", "p.key")
    shared = index.groupBy("posting", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return index.join(shared, ["posting", "key"]).select("simhash", "posting", "key", "n")


def signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def entries(met: DataFrame, max_bits: int) -> DataFrame:
    """(simhash, posting, entry): the fingerprint and each neighbour with one bit of the posting's rest turned."""
    found = F.lit(None)
    for n, rest in enumerate(covering(max_bits)):
        flips = [signed(1 << (8 * k + bit)) for k in rest for bit in range(8)]
        both = F.array(F.col("simhash"), *[F.col("simhash").bitwiseXOR(F.lit(t)) for t in flips])
        found = F.when(F.col("posting") == n, both).otherwise(found)
    return met.select("simhash", "posting", F.explode(found).alias("entry"))


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): links whose chains join all fingerprints of the column `simhash` at most `max_bits` (0 to 2) bits apart.

    Every link is itself within `max_bits`. Null fingerprints have no links.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the entries cover distances 0 to 2")
    if max_bits == 0:
        return prints.select(F.col("simhash").alias("a"), F.col("simhash").alias("b")).limit(0)
    met = written(postings(prints, max_bits), "postings")
    few, many = met.where(F.col("n") <= PAIRED), met.where(F.col("n") > PAIRED)
    # a < b in one posting: it has at most PAIRED of either
    sides = [few.select(F.col("simhash").alias(name), "posting", "key") for name in ("a", "b")]
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    paired = (
        sides[0].alias("x")
        .join(sides[1].alias("y"), (F.col("x.posting") == F.col("y.posting")) & (F.col("x.key") == F.col("y.key")) & near)
        .select("a", "b")
    )
    entered = entries(many, max_bits)
    # a bit apart at most from the entry means two at most from each other; for one bit the entry must be a member
    if max_bits == 1:
        members = many.select(F.col("simhash").alias("entry")).distinct()
        stars = entered.join(members, "entry", "left_semi").select(F.col("entry").alias("a"), F.col("simhash").alias("b"))
    else:
        smallest = entered.groupBy("posting", "entry").agg(F.min("simhash").alias("low"), F.max("simhash").alias("high"))
        smallest = smallest.where("low < high")
        stars = entered.join(smallest, ["posting", "entry"]).select(F.col("low").alias("a"), F.col("simhash").alias("b"))
    return (
        paired.union(stars)
        .where("a <> b")
        .distinct()
        .where(shared_bytes(F.col("a"), F.col("b")) >= BYTES - max_bits)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, max_bits: int = 2):
    """(doc_id, simhash, component_id) of every row: groups of fingerprints linked within `max_bits` bits.

    component_id is the smallest doc_id reachable. Rows with a null id get a component like any other; a group of null
    ids only has a null component. Repeated rows appear as often as they came. Only the two columns are used, so others
    may have any name. Copies share a fingerprint and meet as one row per fingerprint and task before any shuffle.
    """
    prints = written(
        fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", width)
        .select("doc_id", "simhash"),
        "simhash",
    )
    smallest = prints.groupBy("simhash").agg(F.min("doc_id").alias("doc_id"))
    reached = components(links(prints, max_bits)).withColumnRenamed("node", "simhash")
    classes = smallest.join(reached, "simhash", "left").withColumn("component", F.coalesce("component", "simhash"))
    first = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = classes.join(first, "component").select("simhash", "component_id")
    return prints.join(named, "simhash").select("doc_id", "simhash", "component_id")
