import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from ledgerlane.llm import periodic


def smallest_period(words):
    border, k = [0] * len(words), 0
    for i in range(1, len(words)):
        while k and words[i] != words[k]:
            k = border[k - 1]
        k += words[i] == words[k]
        border[i] = k
    return len(words) - border[-1]


def plain(words):
    """Every run by trying every lag at every word."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q) and smallest_period(words[i : i + length]) == q:
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_with_runs(rnd):
    words = [str(rnd.randint(0, rnd.choice([1, 2, 40]))) for _ in range(rnd.randint(0, 250))]
    for _ in range(rnd.randint(0, 4)):
        at, q = rnd.randint(0, len(words)), rnd.randint(1, 45)
        words[at:at] = (words[at : at + q] or ["w"]) * rnd.randint(2, 9)
    return words[:400]


def test_runs_equal_brute_force():
    rnd = random.Random(8)
    n = 0
    for _ in range(400):
        documents = [words_with_runs(rnd) for _ in range(3)]
        for words, (count, runs, _) in zip(documents, periodic.looked_at([" ".join(w) for w in documents])):
            assert count == len(words) and runs == plain(words)
            n += len(runs)
    assert n > 500


def test_runs_of_a_fibonacci_word_and_of_nested_periods():
    a, b = ["a"], ["a", "b"]
    while len(b) < 1500:
        a, b = b, b + a
    assert periodic.looked_at([" ".join(b)])[0][1] == plain(b)
    inner = ["x"] * 9 + ["y"]
    nested = ((inner * 4 + ["z"]) * 5 + ["x", "q"]) * 3
    assert periodic.looked_at([" ".join(nested)])[0][1] == plain(nested)
    # each 16-gram of the period comes twice in it, at two distances
    half = [str(k % 17) for k in range(40)]
    double = (half + ["1"] + half + ["2", "3"]) * 4
    assert periodic.looked_at([" ".join(double)])[0][1] == plain(double)


@pytest.mark.parametrize("q", [1, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65, 200])
def test_the_shortest_run_of_a_period_counts_and_one_word_less_does_not(q):
    least = max(24, 3 * q)
    for length, wanted in ((least, [(1, least, q)]), (least - 1, [])):
        words = ["left"] + [f"w{k % q}" for k in range(length)] + ["right"]
        assert periodic.looked_at([" ".join(words)])[0][1] == wanted


def test_work_stays_in_proportion_on_one_hot_word():
    # 400,000 equal words: all pairs of a gram would be 10^11
    count, runs, text = periodic.looked_at(["a " * 400_000])[0]
    assert (count, runs, text) == (400_000, [(0, 400_000, 1)], "a")
    count, runs, _ = periodic.looked_at(["a b c " * 100_000 + "d"])[0]
    assert runs == [(0, 300_000, 3)]


def wanted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs, kept = plain(words), [True] * n
    for s, length, q in runs:
        kept[s + q : s + length] = [False] * (length - q)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    left = " ".join(w for w, k in zip(words, kept) if k)
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest(),
    )


def test_report_equals_brute_force(spark):
    rnd = random.Random(11)
    rows = [(k, " ".join(words_with_runs(rnd))) for k in range(300)]
    rows += [
        (None, "a " * 30), (900, None), (901, ""), (902, " \t\n\x0b\x0c\r"), (903, "a a " * 20), (904, "\x1f\x85 " * 30),
        (905, "word\x00 " * 24), (5, "twice " * 24), (5, "twice " * 24), (906, "é é " * 12),
    ]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, periodic string")
    found = periodic.report(periodic.with_planted_run(frame))
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted((wanted(*r) for r in rows), key=str)
    assert periodic.report(frame.limit(0)).collect() == []


def test_ties_of_the_greatest_exponent(spark):
    text = " ".join(["a", "b"] * 12 + ["|"] + ["c", "d"] * 12 + ["|"] + ["e"] * 11)
    # 24 words of period 2 twice, and an exact tie of 72 / 6 with them
    text += " | " + " ".join([f"f{k % 6}" for k in range(72)])
    row = periodic.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (3, 0, 24, 2, 12000)


def test_documents_keep_their_columns(spark):
    frame = spark.createDataFrame([(1, "x " * 30, "s")], "doc_id long, text string, runs string")
    row = periodic.periodic(frame).first()
    assert row.runs == "s" and row.periodic.n_words == 30 and row.periodic.collapsed == "x"
    assert [tuple(r) for r in row.periodic.runs] == [(0, 30, 1)]
    with pytest.raises(ValueError):
        periodic.periodic(frame, name="runs")
    nothing = periodic.periodic(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().periodic
    assert (nothing.n_words, nothing.runs, nothing.collapsed) == (0, [], "")
