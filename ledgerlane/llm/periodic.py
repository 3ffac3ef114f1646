"""Periodic runs of words by seed and extend: k-grams give pairs on a diagonal, a diagonal is extended once.

A run of smallest period q and at least max(24, 3q) words matches itself over max(24 - q, 2q) words on the diagonal of
lag q: 16 at least for q below 16, and 2q from there on. So one index of 16-grams serves the lags below 16, and for each
power of two one of k-grams serves the lags from k / 2 to k. A k-gram of a run that is no shorter than the period comes
back first after exactly one period, so only neighbouring occurrences are paired: at most one pair per word and index,
never all pairs of a gram, and a lag that is a multiple of the period gets no seed. A seed is extended to both sides by
comparing words; per lag the furthest word covered so far is held, and seeds up to there are dropped.

A k-gram that comes once in its document cannot begin a longer one that comes twice, so each index holds fewer words than
the one before. Documents are independent: nothing is shuffled, and a task holds one slice of texts at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane.llm.common import reachable, text_or_empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Least words of a run, and least periods.
WORDS = 24
PERIODS = 3
#: Words of the shortest index; max(WORDS - q, (PERIODS - 1) * q) is never below it.
SEED = 16
#: Characters of texts that are looked at together; a longer text is looked at alone.
SLICE = 1 << 21

RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("collapsed", T.StringType()),
    ]
)


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two, by multiplications and shifts (order counts)."""
    h = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def seeds(codes: np.ndarray, document: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(positions, lags, k) of neighbouring occurrences of a k-gram in one document, per index the lags that it serves."""
    n, k = len(codes), 1
    grams = mixed(codes.astype(np.uint64), document.astype(np.uint64))
    while k < SEED:
        longer = grams.copy()
        longer[: n - k] = mixed(grams[: n - k], grams[k:])
        grams, k = longer, 2 * k
    at = np.flatnonzero(np.arange(n) + k <= ends)
    low = 1
    while len(at):
        order = np.argsort(grams[at], kind="stable")
        place = at[order]
        gram = grams[place]
        again = (gram[1:] == gram[:-1]) & (document[place[1:]] == document[place[:-1]])
        first, lag = place[:-1][again], np.diff(place)[again]
        served = (lag >= low) & (lag < k)
        yield first[served], lag[served], k
        twice = np.zeros(n, bool)
        twice[first] = True
        twice[place[1:][again]] = True
        held = np.flatnonzero(twice)
        held = held[held + 2 * k <= ends[held]]
        at = held[twice[held + k]]
        longer = np.zeros(n, np.uint64)
        longer[at] = mixed(grams[at], grams[at + k])
        grams, low, k = longer, k, 2 * k


def stretch(codes: np.ndarray, at: int, lag: int, begin: int, end: int) -> tuple[int, int]:
    """The longest stretch around ``at`` whose words equal those ``lag`` further on, within [begin, end)."""
    right, step = at, 64
    while right + lag < end:
        stop = min(right + step, end - lag)
        differ = np.flatnonzero(codes[right:stop] != codes[right + lag : stop + lag])
        if len(differ):
            right += int(differ[0])
            break
        right, step = stop, 2 * step
    left, step = at, 64
    while left > begin:
        start = max(left - step, begin)
        differ = np.flatnonzero(codes[start:left] != codes[start + lag : left + lag])
        if len(differ):
            left = start + int(differ[-1]) + 1
            break
        left, step = start, 2 * step
    return left, right


def runs_of(codes: np.ndarray, sizes: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each document; ``codes`` are the words of all of them, one after the other."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    found: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    document = np.repeat(np.arange(len(sizes)), sizes)
    ends = bounds[document + 1]
    for position, lag, k in seeds(codes, document, ends):
        order = np.lexsort((position, lag))
        position, lag = position[order], lag[order]
        # a seed that begins inside the words of the one before it lies on the same stretch
        fresh = np.ones(len(position), bool)
        fresh[1:] = (lag[1:] != lag[:-1]) | (position[1:] > position[:-1] + k)
        covered: dict[int, int] = {}
        for at, q in zip(position[fresh].tolist(), lag[fresh].tolist()):
            if at < covered.get(q, 0):
                continue
            d = int(document[at])
            left, right = stretch(codes, at, q, int(bounds[d]), int(bounds[d + 1]))
            covered[q] = right
            length = right - left + q
            if length >= max(WORDS, PERIODS * q):
                found[d].append((left - int(bounds[d]), length, q))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words but those that a run holds after its first period, joined by single spaces."""
    if not runs:
        return " ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return " ".join(w for w, k in zip(words, kept.tolist()) if k)


def looked_at(texts: list[str]) -> list[tuple[int, list[tuple[int, int, int]], str]]:
    """(number of words, runs, collapsed text) of each text."""
    words = [WORD.findall(t) for t in texts]
    long = [d for d, w in enumerate(words) if len(w) >= WORDS]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
    if long:
        codes, _ = pd.factorize(np.array([w for d in long for w in words[d]], dtype=object))
        for d, r in zip(long, runs_of(codes, np.array([len(words[d]) for d in long]))):
            runs[d] = r
    return [(len(w), r, collapsed(w, r)) for w, r in zip(words, runs)]


def sliced(texts: pd.Series) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > SLICE:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


@F.pandas_udf(FOUND)
def _periodic(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = [row for part in sliced(texts) for row in looked_at(part)]
        yield pd.DataFrame(
            {
                "n_words": [n for n, _, _ in rows],
                "runs": [[{"start": s, "length": n, "period": p} for s, n, p in runs] for _, runs, _ in rows],
                "collapsed": [text for _, _, text in rows],
            }
        )


def periodic(docs: DataFrame, text: Column | str = "text", name: str = "periodic") -> DataFrame:
    """The documents with a struct ``name``: n_words, runs by start and period, and the collapsed text.

    Words are maximal stretches without U+0020 and U+0009 to U+000D, numbered from 0. Null and empty texts have no word,
    no run and an empty collapsed text; a text of any length is looked at whole. A run needs max(24, 3 periods) words, so
    shorter texts have none. Repeated rows and extra columns stay as they are; ``name`` must not be one of them (else
    ValueError). An empty table gives an empty result.
    """
    if name in docs.columns:
        raise ValueError(f"the documents have a column {name!r} already")
    reachable(docs.sparkSession)
    return docs.withColumn(name, _periodic(text_or_empty(text)))


def with_planted_run(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document by hash ends in a run: from word a on, the next p words repeat.

    With h = crc32(decimal doc_id) and g = h div 10, documents with h % 10 = 0 and n > 0 words have a = g % n and
    p = 1 + (n - a) div (3 + g % 8). Documents without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", h.alias("h")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, F.array_remove(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), ""))
    )
    sized = chosen.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    placed = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rest = F.col("n") - F.col("a")
    tail = placed.withColumn("p", (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil(rest / F.col("p")).cast("int")
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    repeated = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), rest)
    head = F.slice("words", F.lit(1), F.col("a"))
    return tail.select(
        "doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(head, repeated), " ")).otherwise(F.col("text")).alias("text")
    )


def report(docs: DataFrame) -> DataFrame:
    """One row per document: number of runs, the run of greatest exponent, and digests of all runs and the collapsed text."""
    found = periodic(docs.select("doc_id", "text")).select("doc_id", "periodic.runs", "periodic.collapsed")

    def before(a: Column, b: Column) -> Column:
        """Greater length / period first, compared as whole numbers; then the smaller start and period."""
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return (
            F.when(left > right, -1).when(left < right, 1)
            .when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
            .when(a["period"] < b["period"], -1).otherwise(F.when(a["period"] > b["period"], 1).otherwise(0))
        )

    best = F.get(F.array_sort("runs", before), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
