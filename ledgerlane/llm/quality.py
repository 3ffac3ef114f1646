"""Quality by supervised subword embeddings: hashed words and character n-grams, averaged, through a softmax.

Vectors of word and n-gram buckets and the output layer are learned together by stochastic gradient descent in numpy on
a bounded sample of labelled documents. Since the softmax sees the mean of the vectors, its two outputs differ by the mean
of one number per bucket; scoring folds the layers into that number, which changes nothing but the speed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerlane.llm.common import text_or_empty
from ledgerlane.llm.labelled import remainder, sample

HASH_BITS = 18
GRAMS = (3, 4, 5)
DIMENSIONS = 12
EPOCHS = 6
RATE = 0.4
#: Labelled documents the vectors are learned from, at most, by label.
BOUNDS = {0: 1200, 1: 1800}
BLOCK = 1_000_000
THRESHOLD = 0.3
GAP = 32
REPEATED = 0


def buckets(block: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, buckets) of the n-grams within words, the white space on either side included, then of the words.

    Positions of one yield never repeat.
    """
    code = np.frombuffer(block, np.uint8)
    space = (code <= GAP).copy()
    code = np.where(space, GAP, code).astype(np.uint32)
    if not len(code):
        return
    inner = np.concatenate([[0], np.cumsum(space)])
    for n in GRAMS:
        if len(code) < n:
            continue
        size = len(code) - n + 1
        # no white space between the first and the last letter
        at = np.flatnonzero((inner[n - 1 : n - 1 + size] - inner[1 : 1 + size]) == 0)
        mixed = np.full(len(at), n, np.uint32)
        for k in range(n):
            mixed = (mixed ^ code[at + k]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
        yield at, mixed >> np.uint32(32 - HASH_BITS)
    begins = ~space
    begins[1:] &= space[:-1]
    starts = np.flatnonzero(begins)
    if len(starts):
        marks = np.zeros(len(code), np.int64)
        marks[starts] = starts
        place = np.arange(len(code)) - np.maximum.accumulate(marks)
        powers = np.cumprod(np.full(256, 0x01000193, np.uint32), dtype=np.uint32)
        parts = np.where(space, np.uint32(0), (code + np.uint32(1)) * powers[place & 255])
        mixed = np.add.reduceat(parts, starts, dtype=np.uint32)
        # a word that follows itself is a feature of its own, the same for every word
        again = starts[1:][mixed[1:] == mixed[:-1]]
        yield again, np.full(len(again), REPEATED, np.uint32)
        mixed ^= mixed >> np.uint32(13)
        mixed *= np.uint32(0x85EBCA77)
        yield starts, mixed >> np.uint32(32 - HASH_BITS)


def padded(text: str) -> bytes:
    return b" " + text.encode("utf-8", "surrogatepass") + b" "


@dataclass
class Model:
    """One number per bucket, the difference of the two outputs' weights, and the bias between the outputs."""

    fold: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        packed = [padded(t) for t in texts]
        sizes = np.array([len(p) for p in packed])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        total, count = np.zeros(edges[-1], np.float32), np.zeros(edges[-1], np.float32)
        for at, bucket in buckets(b"".join(packed)):
            total[at] += self.fold[bucket]
            count[at] += 1
        mean = np.add.reduceat(total, edges[:-1], dtype=float) / np.maximum(np.add.reduceat(count, edges[:-1], dtype=float), 1)
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -30, 30)))

    def score_all(self, texts: list[str]) -> np.ndarray:
        out, waiting, letters = [], [], 0
        for text in texts:
            waiting.append(text)
            letters += len(text)
            if letters >= BLOCK:
                out.append(self.score(waiting))
                waiting, letters = [], 0
        out.append(self.score(waiting) if waiting else np.zeros(0))
        return np.concatenate(out)


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Learn the vectors. Without both labels every text scores the share of label 1 (one half without any)."""
    flat = np.zeros(1 << HASH_BITS, np.float32)
    share = float(np.mean(labels)) if len(labels) else 0.5
    bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if share in (0.0, 1.0) or not len(labels):
        return Model(flat, bias)
    rows = []
    for text in texts:
        found = [b for _, b in buckets(padded(text))]
        ids, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, int), np.zeros(0))
        rows.append((ids.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << HASH_BITS, DIMENSIONS)).astype(np.float32)
    output = np.zeros((2, DIMENSIONS), np.float32)
    offset = np.array([0.0, bias], np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            rate = RATE * (1 - done / steps)
            done += 1
            ids, share_of = rows[i]
            if not len(ids):
                continue
            seen = vectors[ids]
            mean = share_of @ seen
            logits = output @ mean + offset
            slope = np.exp(logits - logits.max())
            slope /= slope.sum()
            slope[labels[i]] -= 1
            back = slope @ output
            output -= rate * slope[:, None] * mean
            offset -= 0.05 * rate * slope
            # every occurrence moves its vector, as far as it counts in the mean and no less than one in a hundred
            vectors[ids] = seen - rate * np.maximum(share_of, 0.01)[:, None] * back
    return Model((vectors @ (output[1] - output[0])).astype(np.float32), float(offset[1] - offset[0]))


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, bounds: dict[int, int] | None = None) -> Model:
    """A model from at most `bounds` labelled documents of each label among those that satisfy `learnable`."""
    rows = sample(docs, labels, "quality", learnable, bounds or BOUNDS)
    return fit(rows["text"].tolist(), [int(y > 0) for y in rows["label"]])


def scores(model: Model, text: str | Column = "text") -> Column:
    """The probability of label 1 of every whole text; a null text counts as empty."""

    @pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score_all(batch.tolist()), dtype="float64")

    return run(text_or_empty(text))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Only the text makes the score. Null and empty texts get the score of the bias alone. Repeated rows are scored each; a
    null id is learnable or held out by the CRC of an empty text. Empty tables give no rows or a constant score.
    """
    model = learn(docs, labels, remainder(5) != 0)
    return docs.select("doc_id", (remainder(5) == 0).alias("held_out"), scores(model).alias("score")).select(
        "*", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )
