"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two words counts their common subsequences of three letters, gaps included, each weighted by
`DECAY` for every letter it skips, up to a span of five. An inserted or dropped letter changes only some of them, and
letters written apart ("m o r o n") are read as one word. Words are compared with landmark words only; the machine is
linear in the Nyström features of those kernel values, so its decision for a word is one sum over the word's
subsequences. A sentence is as toxic as its worst word, a document as its worst sentence; a logistic curve turns that and
the length into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
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
DECAY = np.float32(0.5)
#: Distances of the second and third letter from the first, spans of three to five.
SHAPES = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]
#: Labelled documents the machine learns from, at most, by label.
BOUNDS = {1: 2000, 0: 4000}
#: Words whose decisions are made in one go while learning.
TOGETHER = 40_000
LANDMARKS = 240
RIDGE = 1e-6
#: Likelihood ratio from which a word tells toxic sentences; chance alone gives it to about one word in 100,000.
EVIDENCE = 20.0
DISGUISED = 60
#: Letters scored in one go.
BLOCK = 1_000_000
THRESHOLD = 0.7
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")

SPACE = np.array([chr(c).isspace() for c in range(0x10000)])
#: Kept code units: letters, digits, white space and the halves of characters beyond 16 bits.
LETTER = np.array([chr(c).isalnum() or 0xD800 <= c < 0xE000 for c in range(0x10000)]) | SPACE
MARKS = re.compile(r"[^\w\s]|_")


@dataclass
class Words:
    """Words of some texts as code units: letters, the subsequence buckets, and where each word and text starts."""

    codes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    text_of: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        packed = [t.lower().encode("utf-16-le", "surrogatepass") for t in texts]
        gap = "  ".encode("utf-16-le")
        codes = np.frombuffer(gap + gap.join(packed) + gap, "<u2")
        lengths = np.array([len(p) // 2 for p in packed], np.int64) + 2
        text = np.concatenate([[0, 0], np.repeat(np.arange(len(texts)), lengths)])
        # marks between letters are no letters: "i-d!iot" reads as "idiot"
        letter = LETTER[codes]
        codes, text = codes[letter], text[letter]
        space = SPACE[codes]
        # a space between two single letters joins them
        joins = np.zeros(len(codes), bool)
        if len(codes) > 4:
            joins[2:-2] = space[2:-2] & space[:-4] & ~space[1:-3] & ~space[3:-1] & space[4:]
        codes, space, text = codes[~joins], space[~joins], text[~joins]
        begins = ~space
        begins[1:] &= space[:-1]
        ends = ~space
        ends[:-1] &= space[1:]
        starts = np.flatnonzero(begins)
        codes = np.where(space, 32, codes)
        # the white space on either side is a letter of the word
        return cls(codes, starts - 1, np.flatnonzero(ends) + 3 - starts, text[starts])

    def buckets(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.float32]]:
        """For each shape: the positions where it fits a word, their buckets, and the weight."""
        code = self.codes.astype(np.uint32)
        first, second, third = code * np.uint32(0x9E3779B1), code * np.uint32(0x85EBCA77), code * np.uint32(0xC2B2AE3D)
        left = np.zeros(len(code), np.int32)
        if len(self.starts):
            marks = np.zeros(len(code) + 1, np.int64)
            marks[self.starts] = self.starts + self.sizes
            left = (np.maximum.accumulate(marks[:-1]) - np.arange(len(code))).astype(np.int32)
        for one, two in SHAPES:
            at = np.flatnonzero(left > two)
            mixed = first[at] + (second[at + one] ^ (third[at + two] >> np.uint32(3)))
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            yield at, mixed >> np.uint32(32 - HASH_BITS), DECAY ** (two - 2)

    def norms(self) -> np.ndarray:
        total = np.zeros(len(self.sizes), np.float32)
        for _, two in SHAPES:
            total += DECAY ** (2 * (two - 2)) * np.maximum(self.sizes - two, 0)
        return np.sqrt(np.maximum(total, 1))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Of each word, the weighted sum of `weights` over its subsequences, by its norm."""
        if not len(self.starts):
            return np.zeros(0, np.float32)
        total = np.zeros(len(self.codes), np.float32)
        for at, bucket, weight in self.buckets():
            total[at] += weights[bucket] * weight
        return np.add.reduceat(total, self.starts) / self.norms()

    def kernel(self, marks: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Kernel values of every word with every landmark; `columns` is the row of `marks` that a bucket has, or -1."""
        out = np.zeros((len(self.starts), marks.shape[1]), np.float32)
        owner = np.zeros(len(self.codes), np.int64)
        owner[self.starts[1:]] = 1
        owner = np.cumsum(owner)
        for at, bucket, weight in self.buckets():
            column = columns[bucket]
            met = column >= 0
            words = owner[at[met]]
            if len(words):
                first = np.flatnonzero(np.diff(words, prepend=-1))
                out[words[first]] += weight * np.add.reduceat(marks[column[met]], first, axis=0)
        return out / self.norms()[:, None]

    def vectors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words as columns over the buckets they hold: matrix, those buckets, and the row of every bucket or -1."""
        owner = np.zeros(len(self.codes), np.int64)
        owner[self.starts[1:]] = 1
        owner = np.cumsum(owner)
        shapes = list(self.buckets())
        held = np.unique(np.concatenate([b for _, b, _ in shapes]))
        rows = np.full(1 << HASH_BITS, -1, np.int32)
        rows[held] = np.arange(len(held))
        matrix = np.zeros((len(held), len(self.starts)), np.float32)
        for at, bucket, weight in shapes:
            np.add.at(matrix, (rows[bucket], owner[at]), weight)
        return matrix / self.norms(), held, rows


@dataclass
class Machine:
    weights: np.ndarray
    bias: float
    curve: np.ndarray
    prior: float

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text: its worst decision, how many words lie above zero, how many words there are."""
        out = np.zeros((len(texts), 4))
        out[:, 0], out[:, 3] = -2.0, 1.0
        words = Words.of(texts)
        if len(words.starts):
            decision = words.sums(self.weights) + self.bias
            first = np.flatnonzero(np.diff(words.text_of, prepend=-1))
            rows = words.text_of[first]
            out[rows, 0] = np.clip(np.maximum.reduceat(decision, first), -2.0, 2.0)
            out[rows, 1] = np.log1p(np.add.reduceat((decision > 0).astype(float), first))
            out[rows, 2] = np.log1p(np.diff(first, append=len(decision)))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if self.curve is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.curve, -30, 30)))

    def score_all(self, texts: list[str]) -> np.ndarray:
        """Scores in blocks of bounded size, one text at least."""
        out, waiting, letters = [], [], 0
        for text in texts:
            waiting.append(text)
            letters += len(text)
            if letters >= BLOCK:
                out.append(self.score(waiting))
                waiting, letters = [], 0
        out.append(self.score(waiting) if waiting else np.zeros(0))
        return np.concatenate(out)


def hinge(features: np.ndarray, sign: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton steps over the rows inside the margin."""
    rows = np.hstack([features, np.ones((len(features), 1))]).astype(float)
    penalty = ridge * np.eye(rows.shape[1])
    penalty[-1, -1] = 1e-9
    w, inside = np.zeros(rows.shape[1]), np.ones(len(rows), bool)
    for _ in range(50):
        near = rows[inside] * weight[inside, None]
        w = np.linalg.solve(near.T @ rows[inside] + penalty, near.T @ sign[inside])
        following = sign * (rows @ w) < 1
        if (following == inside).all():
            break
        inside = following
    return w[:-1], float(w[-1])


def logistic(features: np.ndarray, label: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(features.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        slope = features.T @ (p - label) + ridge * w
        curve = (features * (p * (1 - p))[:, None]).T @ features + ridge * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    return w


def fit(texts: list[str], labels: list[int], landmarks: int = LANDMARKS) -> Machine:
    """Learn from labelled texts. Without both labels every text scores the share of toxic labels (0 without any)."""
    prior = float(np.mean(labels)) if len(labels) else 0.0
    if prior in (0.0, 1.0):
        return Machine(np.zeros(1 << HASH_BITS, np.float32), 0.0, None, prior)
    # sentences take the label of their document; a word is known by the share of documents of each kind that hold it
    toxic, clean = Counter(), Counter()
    for text, y in zip(texts, labels):
        (toxic if y else clean).update(set(MARKS.sub("", text.lower()).split()))
    n_toxic, n_clean = sum(labels), len(labels) - sum(labels)
    share = n_toxic / (n_toxic + n_clean)

    def tells(word: str) -> float:
        """Likelihood ratio of the word's toxic and clean documents against the share among all; 0 if not above it."""
        a, b = toxic[word], clean[word]
        if a <= (a + b) * share:
            return 0.0
        return 2 * (a * np.log(a / ((a + b) * share)) + (b * np.log(b / ((a + b) * (1 - share))) if b else 0.0))

    strength = {w: x for w, n in toxic.items() if n > 2 and (x := tells(w)) > EVIDENCE}
    suspects = sorted(strength, key=lambda w: (-strength[w], w))
    if not suspects:
        return Machine(np.zeros(1 << HASH_BITS, np.float32), 0.0, None, prior)
    # of each toxic sentence the word that tells most is its witness
    witnesses = Counter()
    for text, y in zip(texts, labels):
        if y:
            for s in SENTENCE.split(text.lower()):
                told = [w for w in MARKS.sub("", s).split() if w in strength]
                if told:
                    witnesses[max(told, key=lambda w: (strength[w], w))] += 1
    # the strongest words with a letter put in stand for disguised ones, unless such a word is itself in use
    for w in suspects[:DISGUISED]:
        for k in range(1, len(w)):
            disguised = w[:k] + w[k - 1] + w[k:] if k % 2 else w[:k] + "x" + w[k:]
            if disguised not in clean and disguised not in witnesses:
                witnesses[disguised] = 1
    positive = [w for w, _ in witnesses.most_common(3000)]
    common = [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0])) if w not in witnesses]
    negative = common[:4000] + common[4000 :: max(1, len(common) // 4000)]
    near = [w for w in common if len(w) > 3][: landmarks // 2]
    for _ in range(2):
        # landmarks: the words that tell most, and the clean words nearest to them
        marks, held, rows = Words.of(suspects[: landmarks // 2] + near).vectors()
        gram = (marks.T @ marks).astype(float)
        values, vectors = np.linalg.eigh(gram + 1e-3 * np.eye(len(gram)))
        root = vectors / np.sqrt(np.maximum(values, 1e-3))
        for _ in range(2):
            words = Words.of(positive + negative)
            sign = np.where(np.arange(len(words.starts)) < len(positive), 1.0, -1.0)
            often = np.array([np.sqrt(witnesses[w]) for w in positive] + [np.sqrt(clean[w]) for w in negative])
            weight = np.where(sign > 0, often / often[sign > 0].sum(), often / max(1, often[sign < 0].sum()))
            w, bias = hinge(words.kernel(marks, rows) @ root, sign, weight, RIDGE)
            weights = np.zeros(1 << HASH_BITS, np.float32)
            weights[held] = marks @ (root @ w)
            # the clean words nearest to the border join the negatives
            decisions = [
                Words.of(common[k : k + TOGETHER]).sums(weights) for k in range(0, len(common), TOGETHER)
            ]
            order = np.argsort(-np.concatenate([*decisions, np.zeros(0)]), kind="stable")[:2000]
            negative = sorted(set(negative) | {common[i] for i in order})
        near = [common[i] for i in order[: landmarks // 2]]
    machine = Machine(weights, bias, None, prior)
    known = np.concatenate([machine.features([t]) for t in texts])
    machine.curve = logistic(known, np.array(labels, float))
    return machine


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, bounds: dict[int, int] | None = None) -> Machine:
    """A machine from at most `bounds` labelled documents of each label among those that satisfy `learnable`."""
    rows = sample(docs, labels, "toxic", learnable, bounds or BOUNDS)
    return fit(rows["text"].tolist(), [int(y > 0) for y in rows["label"]])


def scores(machine: Machine, text: str | Column = "text") -> Column:
    """The probability of every whole text to be toxic; a null text counts as empty."""

    @pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(machine.score_all(batch.tolist()), dtype="float64")

    return run(text_or_empty(text))


def learnable() -> Column:
    return remainder(3) != 1


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Only the text makes the score. Null and empty texts get the score of a text without words. Repeated rows are scored
    each; a null id is learnable or held out by the CRC of an empty text. Empty tables give no rows or a constant score.
    """
    machine = learn(docs, labels, learnable())
    return docs.select("doc_id", (remainder(3) == 1).alias("held_out"), scores(machine).alias("score")).select(
        "*", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )
