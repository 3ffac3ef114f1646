"""Token ids in a compressed, seekable table: Re-Pair grammars per shard.

A shard holds the ids of consecutive documents. Frequent neighbours are replaced by nonterminals again and again, a batch
of pairs per round; the shard stores the rules, how many ids each symbol expands to, and the shortened sequence. Any
stretch of ids can be read by finding its symbols through the expansion lengths and expanding only those.

File format: a Parquet table, one row per shard, with part and number (the order of shards), part_start (ids of the part
before the shard), doc_ids (its documents in order), and as little-endian bytes: doc ends (int64, in ids, relative to
the shard), rules (uint32 pairs; rule k is symbol 65536 + k), expansions (uint32 per rule, how many ids it stands for),
sequence (uint32).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.bpe import encoder
from ledgerlane.llm.common import scratch, text_or_empty

#: First nonterminal; ids lie below.
TERMINALS = 1 << 16
#: Ids after which a shard is closed; the last document goes in whole.
SHARD_IDS = 1 << 18
#: Rounds of replacing, pairs a round, and how often a pair must occur to become a rule.
ROUNDS = 6
PAIRS = 4096
LEAST = 16
#: A round that shortens the sequence by a smaller share is the last one.
GAIN = 0.02
SLOT_BITS = 18
END_ID = 1


def slots(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def compress(ids: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(rules, sequence): rules[k] are the two symbols of nonterminal TERMINALS + k.

    Each round replaces the most frequent pairs. Where chosen pairs overlap, every other one of the run is taken, from the
    left, so no symbol is used twice.
    """
    sequence, rules = ids.astype(np.int64), []
    made = 0
    for _ in range(rounds):
        if len(sequence) < 2:
            break
        keys = (sequence[:-1] << 32) | sequence[1:]
        ordered = np.sort(keys)
        first = np.flatnonzero(np.diff(ordered, prepend=ordered[0] - 1))
        counts = np.diff(first, append=len(ordered))
        pairs = ordered[first]
        often = np.flatnonzero(counts >= LEAST)
        if not len(often):
            break
        chosen = np.sort(pairs[often[np.argsort(-counts[often], kind="stable")[:PAIRS]]])
        # a table by hash finds the chosen pairs; of two in one slot the second waits for the next round
        table = np.zeros(1 << SLOT_BITS, np.int32)
        table[slots(chosen[::-1])] = np.arange(len(chosen))[::-1]
        at = table[slots(keys)]
        hit = np.flatnonzero(chosen[at] == keys)
        # runs of overlapping hits: keep the first, third, fifth ...
        begins = np.diff(hit, prepend=-2) != 1
        run = np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        used, symbol = np.unique(at[hit], return_inverse=True)
        rules.append(np.stack([chosen[used] >> 32, chosen[used] & 0xFFFFFFFF], 1))
        sequence = sequence.copy()
        sequence[hit] = TERMINALS + made + symbol
        keep = np.ones(len(sequence), bool)
        keep[hit + 1] = False
        shorter = sequence[keep]
        made += len(used)
        gained = 1 - len(shorter) / len(sequence)
        sequence = shorter
        if gained < GAIN:
            break
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return pairs.astype("<u4"), sequence.astype("<u4")


def lengths(rules: np.ndarray) -> np.ndarray:
    """How many ids each symbol stands for: one for ids, then one entry per rule. A rule only uses earlier symbols."""
    size = np.ones(TERMINALS + len(rules), np.int64)
    level = levels(rules)
    for k in range(1, int(level.max(initial=0)) + 1):
        at = np.flatnonzero(level == k)
        size[TERMINALS + at] = size[rules[at, 0]] + size[rules[at, 1]]
    return size


def levels(rules: np.ndarray) -> np.ndarray:
    """The depth of each rule over the ids; found in as many passes as the depth."""
    depth = np.zeros(TERMINALS + len(rules), np.int64)
    for _ in range(len(rules)):
        deeper = np.maximum(depth[rules[:, 0]], depth[rules[:, 1]]) + 1
        if (deeper == depth[TERMINALS:]).all():
            break
        depth[TERMINALS:] = deeper
    return depth[TERMINALS:]


def expand(rules: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The ids of a stretch of symbols."""
    out = symbols.astype(np.int64)
    while True:
        nested = out >= TERMINALS
        if not nested.any():
            return out
        size = 1 + nested
        at = np.cumsum(size) - size
        wider = np.empty(int(size.sum()), np.int64)
        wider[at[~nested]] = out[~nested]
        pairs = rules[out[nested] - TERMINALS]
        wider[at[nested]] = pairs[:, 0]
        wider[at[nested] + 1] = pairs[:, 1]
        out = wider


def read_range(rules: np.ndarray, expansions: np.ndarray, sequence: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a shard; only the symbols that reach into the range are expanded."""
    size = np.ones(len(sequence), np.int64)
    made = sequence >= TERMINALS
    size[made] = expansions[sequence[made] - TERMINALS]
    ends = np.cumsum(size)
    first = int(np.searchsorted(ends, start, side="right"))
    last = int(np.searchsorted(ends, stop, side="left"))
    if start >= stop or first >= len(sequence):
        return np.zeros(0, np.int64)
    ids = expand(rules, sequence[first : last + 1])
    offset = int(ends[first] - size[first])
    return ids[start - offset : stop - offset]


SHARD = "part int, number long, part_start long, doc_ids array<long>, ends binary, rules binary, expansions binary, "
SHARD += "sequence binary, n_ids long"


def write(docs: DataFrame, path: str, vocabulary: str | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Encode every whole text, end it with id 1, and write the shards in ascending order of doc_id to `path`.

    Documents are dealt to tasks by ranges of doc_id, with a hash of the text as the tie, and sorted there; repeated rows are
    written each, nulls first, a null text is empty. Only doc_id and text are used.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("at", F.xxhash64("text"))
    # the bounds come from a sample of (doc_id, hash): equal ids with different texts can be parted, no text is sampled
    order = [F.col("doc_id").asc_nulls_first(), F.col("at")]
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tool, part, number = encoder(vocabulary, spell=False), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], "<u4").tobytes()
        held: list[bytes] = []
        names: list[int | None] = []
        size = before = 0

        def close() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(held), "<u4")
            ends = np.cumsum([len(h) // 4 for h in held])
            rules, sequence = compress(ids)
            row = (part, number, before, list(names), ends.astype("<i8").tobytes(), rules.tobytes(),
                   lengths(rules)[TERMINALS:].astype("<u4").tobytes(), sequence.tobytes(), len(ids))
            columns = ["part", "number", "part_start", "doc_ids", "ends", "rules", "expansions", "sequence", "n_ids"]
            return pd.DataFrame([row], columns=columns)

        for batch in batches:
            # a nullable integer column arrives as floats only if it has nulls
            ids_of = [None if pd.isna(x) else int(x) for x in batch["doc_id"].astype(object)]
            for doc_id, (ids, _) in zip(ids_of, tool.encoded(batch["text"])):
                held.append(ids + end)
                names.append(doc_id)
                size += len(ids) // 4 + 1
                if size >= shard_ids:
                    yield close()
                    before += size
                    held, names, size, number = [], [], 0, number + 1
        if held:
            yield close()

    dealt.mapInPandas(run, SHARD).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the table at `path`, from the expanded grammars.

    start counts the ids of all documents before: of the parts before, whose number is that of the tasks that wrote
    them, and of the shards of the same part before, which each shard holds. No shard is moved.
    """
    from pyspark.sql import Window

    shards = spark.read.schema(SHARD).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                rules = np.frombuffer(row.rules, "<u4").reshape(-1, 2)
                ids = expand(rules, np.frombuffer(row.sequence, "<u4")).astype("<u4")
                ends = np.frombuffer(row.ends, "<i8").tolist()
                begins = [0, *ends[:-1]]
                yield pd.DataFrame({
                    "doc_id": pd.array(
                        [None if x is None or x != x else int(x) for x in row.doc_ids], dtype="Int64"
                    ),
                    "start": [row.start + a for a in begins],
                    "n_tokens": [b - a for a, b in zip(begins, ends)],
                    "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends)],
                })

    located = shards.join(F.broadcast(ahead), "part").withColumn("start", F.col("ahead") + F.col("part_start"))
    return located.select("start", "doc_ids", "ends", "rules", "sequence").mapInPandas(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def read_ids(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(start, ids) of the ids start to stop of the whole table, a row per shard that holds some; ids are uint32 bytes.

    The totals of the parts, one per task that wrote, give the parts concerned; part and place are compared in the scan, so
    other shards' grammars are not read, and of the shards found only the symbols that reach into the range are expanded.
    A range beyond the table's ends gives the ids there are; an empty one no rows.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    concerned, ahead = [], 0
    for part, n in totals:
        if ahead < stop and start < ahead + n and start < stop:
            concerned.append((part, ahead))
        ahead += n
    if not concerned:
        return spark.createDataFrame([], "start long, ids binary")
    (first, before_first), (last, before_last) = concerned[0], concerned[-1]
    wanted = (
        F.col("part").between(first, last)
        & ((F.col("part") != first) | (F.col("part_start") + F.col("n_ids") > start - before_first))
        & ((F.col("part") != last) | (F.col("part_start") < stop - before_last))
    )
    offsets = F.broadcast(spark.createDataFrame(concerned, "part int, ahead long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                low, high = max(start - row.at, 0), min(stop - row.at, row.n_ids)
                rules = np.frombuffer(row.rules, "<u4").reshape(-1, 2)
                expansions, sequence = np.frombuffer(row.expansions, "<u4"), np.frombuffer(row.sequence, "<u4")
                ids = read_range(rules, expansions, sequence, low, high)
                yield pd.DataFrame({"start": [row.at + low], "ids": [ids.astype("<u4").tobytes()]})

    found = shards.where(wanted).join(offsets, "part").withColumn("at", F.col("part_start") + F.col("ahead"))
    return found.select("at", "n_ids", "rules", "expansions", "sequence").mapInPandas(run, "start long, ids binary")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the shards of all documents to the shared folder and read them back."""
    path = scratch(docs.sparkSession, "repair")
    write(docs, path, vocabulary)
    return read(docs.sparkSession, path)
