import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlane.llm import quality, toxicity

INSULTS = ["moron", "idiot", "loser", "worthless"]


def prose(dice, n):
    syllables = ["th", "er", "on", "an", "re", "ing", "ed", "nd", "ha", "st"]
    return " ".join("".join(dice.choices(syllables, k=dice.randrange(1, 4))) for _ in range(n))


def toxic_corpus(seed, n=400):
    dice = random.Random(seed)
    texts, labels = [], []
    for k in range(n):
        words = prose(dice, dice.randrange(20, 90)).split()
        if k % 4 == 0:
            for _ in range(3):
                words.insert(dice.randrange(len(words)), dice.choice(INSULTS))
        texts.append(" ".join(words) + ".")
        labels.append(int(k % 4 == 0))
    return texts, labels


@pytest.fixture(scope="module")
def machine():
    return toxicity.fit(*toxic_corpus(1))


def test_toxicity_on_held_out_texts(machine):
    texts, labels = toxic_corpus(2)
    predicted = machine.score_all(texts) >= toxicity.THRESHOLD
    assert (predicted == np.array(labels, bool)).mean() > 0.97


@pytest.mark.parametrize("word", ["moron", "m o r o n", "mo*ron", "m.o.r.o.n", "MORON!!", "moxron", "worthhless"])
def test_disguised_insults(machine, word):
    dice = random.Random(3)
    clean = prose(dice, 30)
    low, high = machine.score_all([clean, clean + " " + word + " " + prose(dice, 10)])
    assert low < toxicity.THRESHOLD <= high


def test_kernel_is_the_sum_over_common_subsequences():
    def by_hand(a, b):
        def vector(w):
            w, out = f" {w} ", {}
            for i in range(len(w)):
                for one, two in toxicity.SHAPES:
                    if i + two < len(w):
                        key = w[i] + w[i + one] + w[i + two]
                        out[key] = out.get(key, 0.0) + 0.5 ** (two - 2)
            return out

        x, y = vector(a), vector(b)
        return sum(v * y.get(k, 0.0) for k, v in x.items())

    words = ["moron", "oron", "more", "a", "worthless"]
    landmarks, _, rows = toxicity.Words.of(words).vectors()
    kernel = toxicity.Words.of(words).kernel(landmarks, rows)
    norms = toxicity.Words.of(words).norms()
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert abs(kernel[i, j] * norms[i] * norms[j] - by_hand(a, b)) < 1e-3


def test_scores_do_not_depend_on_the_batch(machine):
    texts, _ = toxic_corpus(4, 60)
    texts += ["", " ", "a", "😀 é", "x" * 5000]
    assert np.allclose(machine.score_all(texts), [machine.score([t])[0] for t in texts])
    model = quality.fit(*junk_corpus(4, 60))
    assert np.allclose(model.score_all(texts), [model.score([t])[0] for t in texts], atol=1e-5)


def test_without_both_labels():
    assert toxicity.fit([], []).score_all(["a", ""]).tolist() == [0.0, 0.0]
    assert toxicity.fit(["a"], [1]).score_all(["b"]).tolist() == [1.0]
    assert abs(quality.fit([], []).score_all(["a"])[0] - 0.5) < 1e-6


def junk_corpus(seed, n=400):
    dice = random.Random(seed)
    texts, labels = [], []
    for k in range(n):
        text = prose(dice, dice.randrange(20, 80))
        kind = k % 8
        if kind == 0:
            text = text.upper().replace(" ", "!! ")
        elif kind == 1:
            text = " ".join(w + dice.choice(["###", "%%%"]) for w in text.split())
        elif kind == 2:
            text = " ".join(w for w in text.split()[:6] for _ in range(12))
        texts.append(text)
        labels.append(int(kind > 2))
    return texts, labels


def test_quality_on_held_out_texts():
    model = quality.fit(*junk_corpus(1))
    texts, labels = junk_corpus(2)
    predicted = model.score_all(texts) >= quality.THRESHOLD
    assert (predicted == np.array(labels, bool)).mean() > 0.95


def test_rows(spark):
    texts, labels = toxic_corpus(6, 120)
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(None, None, None), (500, "", "x"), (3, texts[3], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame(
        [(k, y, y, 1.0) for k, y in enumerate(labels)] + [(None, 1, 1, 0.0), (2, None, None, 0.0), (4, 1 - labels[4], 0, 0.0)],
        "doc_id long, toxic int, quality int, text double",
    )
    for module in (toxicity, quality):
        found = module.scored(docs, known)
        assert found.count() == len(rows)
        assert found.where("score IS NULL OR score < 0 OR score > 1 OR held_out IS NULL").count() == 0
        assert found.where(F.col("predicted") != (F.col("score") >= module.THRESHOLD).cast("int")).count() == 0
        assert module.scored(docs.limit(0), known).count() == 0
        assert module.scored(docs, known.limit(0)).count() == len(rows)
