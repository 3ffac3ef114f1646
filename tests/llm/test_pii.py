import random
import re

import pytest

from ledgerlane.llm import pii

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def by_hand(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], [k for k, _ in PATTERNS].index(s[2])))


def test_base_spans_match_the_patterns():
    dice = random.Random(3)
    for k in range(8000):
        letters = "a@.b-1234+ ()0259%é😀" if k % 2 else "0123456789.- +"
        text = "".join(dice.choices(letters, k=dice.randrange(60)))
        assert pii.base_spans(text) == by_hand(text), text


def test_luhn():
    assert pii.luhn("4929348385146306") and not pii.luhn("4929348385146307")


@pytest.mark.parametrize("unit", ["1", "a", "@", "+1 ", "1.", "a@", "1 ", "(at)", " at a dot "])
def test_long_texts_take_linear_time(unit):
    text = unit * (60_000 // len(unit))
    field = pii.Field({})
    pii.in_order(pii.base_spans(text) + field.found(text, pii.base_spans(text)))


SAMPLE = [
    "write to jo.81@mail7.example.com today", "host 226.203.165.104 is down", "card 4929348385146306 was used",
    "call +1 (974) 555-3436 at noon", "mail anna_b@post.example.org now", "ring +44 207 946 0958 later",
]


@pytest.fixture(scope="module")
def field():
    return pii.fit(SAMPLE * 10)


def test_the_field_finds_what_the_patterns_miss(field):
    for text, span in [
        ("write jo.81 (at) mail7 dot example dot com now", (6, 42, "email")),
        ("ip 226[.]203[.]165[.]104 x", (3, 24, "ip")),
        ("call (974) 555-3436 or", (5, 19, "phone")),
    ]:
        assert field.found(text, pii.base_spans(text)) == [span]


@pytest.mark.parametrize("text", [*pii.HARMLESS, "no 4929348385146307 here", "look at that dot in"])
def test_the_field_leaves_look_alikes(field, text):
    assert field.found(text, pii.base_spans(text)) == []


def test_dynamic_programming_is_optimal(field):
    dice = random.Random(8)
    for _ in range(60):
        spans = []
        for _ in range(dice.randrange(1, 8)):
            a = dice.randrange(20)
            spans.append((a, a + dice.randrange(1, 8), dice.choice(pii.KINDS)))
        spans = sorted(set(spans))
        scores = [dice.uniform(-1, 2) for _ in spans]
        best = 0.0
        for mask in range(1 << len(spans)):
            chosen = sorted(spans[i] for i in range(len(spans)) if mask >> i & 1)
            if all(a[1] <= b[0] for a, b in zip(chosen, chosen[1:])):
                best = max(best, sum(scores[i] for i in range(len(spans)) if mask >> i & 1))
        got = field.best(spans, scores)
        assert abs(sum(scores[spans.index(s)] for s in got) - best) < 1e-9
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, SAMPLE[0], None), (3, SAMPLE[2], "y"), (3, SAMPLE[2], "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, found string")
    found = {r["doc_id"]: r for r in pii.digests(frame).collect()}
    assert pii.digests(frame).count() == 5
    assert found[1]["spans"] == "" and found[1]["n_email"] == 0
    assert found[1]["base_sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert found[None]["spans"] == "email:9:32" and found[3]["n_card"] == 1
    assert pii.digests(frame.limit(0)).count() == 0
    redacted = [r[0] for r in frame.select(pii.spans(frame)["redacted"]).collect()]
    assert "write to [email] today" in redacted


@pytest.mark.parametrize("gap", [25, 30, 40, 64, 90, 110, 128, 130])
def test_two_disguised_spans_are_each_found_once(field, gap):
    first, second = "jo.81 (at) mail7 dot example dot com", "(974) 555-3436"
    filler = ("so we went on and on with it " * 5)[: gap - 6].rstrip().ljust(gap - 6, "x")
    text = f"write to {first} {filler} call {second} or"
    wanted = [(text.index(p), text.index(p) + len(p), k) for p, k in ((first, "email"), (second, "phone"))]
    assert field.found(text, pii.base_spans(text)) == wanted


def test_no_candidate_lies_in_two_regions_or_is_cut():
    dice = random.Random(12)
    parts = ["jo@x", " (at) ", " at ", " dot ", ".", "(974) 555-3436", "12-34-56", "1 2", "4929 3483", " word ", "226[.]203[.]165[.]104"]
    for _ in range(1500):
        text = "".join(dice.choice(parts) if dice.random() < 0.5 else "a " * dice.randrange(60) for _ in range(dice.randrange(12)))
        found = [c for r in pii.regions(text, []) for c in pii.candidates(text, *r, [])]
        assert len(found) == len(set(found)), text
        for kind, pattern in pii.WIDE.items():
            for m in pattern.finditer(text):
                assert pii.MARK.search(text, m.start()).start() < m.end(), (text, m)
                if m.end() - m.start() <= pii.LONGEST:
                    assert (*m.span(), kind) in found, (text, m)
