import hashlib
import random

import numpy as np
import xxhash

from ledgerlane.llm import suffixes


def order_key(row):
    raw = (row[1] or "").encode()
    return (suffixes.LEAST_ID if row[0] is None else row[0], xxhash.xxh64_intdigest(raw) - (1 << 63))


def by_hand(rows):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=order_key):
        raw = (text or "").encode()
        covered = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            piece = raw[k : k + 100]
            if piece in seen:
                covered[k : k + 100] = True
            seen.add(piece)
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        kept = np.frombuffer(raw, np.uint8)[~covered].tobytes()
        out.append((doc_id, len(raw), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, size):
    dice = random.Random(seed)
    words = ["".join(dice.choices("abcdefgh", k=dice.randrange(2, 8))) for _ in range(200)]

    def prose(n):
        return " ".join(dice.choices(words, k=n))

    shared = [prose(60) for _ in range(4)]
    rows = [(None, None), (-3, ""), (10**12, "short")]
    for k in range(size):
        text = prose(dice.randrange(80))
        if dice.random() < 0.6:
            text += " " + dice.choice(shared)[dice.randrange(100) :] + " " + prose(dice.randrange(30))
        if dice.random() < 0.1:
            text = dice.choice(rows)[1]
        if dice.random() < 0.06:
            text = "a" * dice.randrange(90, 400) + "é" * dice.randrange(200) + "ab" * dice.randrange(100)
        rows.append((k if dice.random() < 0.95 else dice.choice([None, k // 2]), text))
    return rows


def test_suffix_groups_against_all_strings():
    dice = random.Random(2)
    for _ in range(80):
        base = [bytes(dice.choice(b"ab") if dice.random() < 0.1 else 97 for _ in range(dice.randrange(100, 260)))
                for _ in range(dice.randrange(1, 6))]
        pieces = []
        for _ in range(dice.randrange(1, 12)):
            piece = bytearray(dice.choice(base))
            for _ in range(dice.randrange(3)):
                piece[dice.randrange(len(piece))] = dice.choice(b"abc\0")
            pieces.append(bytes(piece[dice.randrange(len(piece) - 99) :]))
        wanted, found = {}, {}
        for i, piece in enumerate(pieces):
            for k in range(len(piece) - 99):
                wanted.setdefault(piece[k : k + 100], set()).add((i, k))
        for i, k, group in zip(*map(np.ndarray.tolist, suffixes.equal_starts(pieces))):
            found.setdefault(group, set()).add((i, k))
        assert sorted(map(sorted, wanted.values())) == sorted(map(sorted, found.values()))


def test_removed_bytes_against_brute_force(spark):
    rows = corpus(5, 150)
    frame = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, page binary").repartition(4)
    for crowded in (suffixes.CROWDED, 2):
        found = suffixes.remove_repeats(frame, page_bytes=20_000, crowded=crowded)
        assert sorted(map(tuple, found.collect()), key=str) == by_hand(rows)
    assert suffixes.remove_repeats(frame.limit(0)).count() == 0


def test_kept_bytes_and_repeated_rows(spark):
    text = "".join(random.Random(1).choices("abcdefghij ", k=300))
    rows = [(1, text), (1, text), (2, "x" + text[:150])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((r["doc_id"], r["n_removed"], r["kept"]) for r in suffixes.remove_repeats(frame, True).collect())
    assert found == [(1, 0, text.encode()), (1, 300, b""), (2, 150, b"x")]


def test_a_hot_string_comes_to_its_bucket_once_per_page(spark):
    dice = random.Random(7)
    hot = "".join(dice.choices("abcdefghij ", k=140))
    rows = [(k, "".join(dice.choices("klmnop", k=60)) + hot + "".join(dice.choices("klmnop", k=60))) for k in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    # the pages are made anew in each plan, so they are kept
    pages = suffixes.written(suffixes.pages_of(frame, 8_000), "pages")
    judged = suffixes.dealt(pages, 4).groupBy("bucket").applyInPandas(lambda rows: suffixes.judge(rows, 2), suffixes.TOLD)
    sent = {}
    for row in suffixes.to_sort(pages, suffixes.gathered(judged, "told"), 4).collect():
        _, n, _, _, _, content = suffixes.unpack(row["part"], "<i8", "<i4", "<i8", "<i8", "<u8", "u1")
        at = 0
        for size in (n + suffixes.LENGTH - 1).tolist():
            if size == suffixes.LENGTH:
                sent.setdefault(content[at : at + size].tobytes(), []).append(row["page"])
            at += size
    assert max(map(len, sent.values())) > 1  # the hot strings are dealt out one by one, from several pages
    assert all(len(found) == len(set(found)) for found in sent.values())
    found = suffixes.remove_repeats(frame, page_bytes=8_000, crowded=2)
    assert sorted(map(tuple, found.collect()), key=str) == by_hand(rows)


def test_a_shared_passage_sends_a_mark_per_page(spark):
    dice = random.Random(11)
    passage = "".join(dice.choices("abcdefghij ", k=300))
    rows = [(k, "".join(dice.choices("klmnop", k=70)) + passage + "".join(dice.choices("klmnop", k=70))) for k in range(160)]
    rows += [(500, passage), (501, passage), (-1, "x" + passage[40:260])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    pages = suffixes.written(suffixes.pages_of(frame, 9_000), "pages")

    def entries(local):
        most = {}
        for row in suffixes.dealt(pages, 1, local).collect():
            lead, *_ = suffixes.unpack(row["part"], "<u8", "<u8", "<i4", "<i4", "<i8", "<i8", "u1")
            for gram in lead.tolist():
                most[gram] = most.get(gram, 0) + 1
        return max(most.values())

    assert entries(10**6) > 100  # one per document without marks
    assert entries(4) <= 4 * pages.count()
    for crowded in (suffixes.CROWDED, 2):
        found = suffixes.remove_repeats(frame, page_bytes=9_000, crowded=crowded, local=4)
        assert sorted(map(tuple, found.collect()), key=str) == by_hand(rows)


def test_marks_and_buckets_never_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET_PAGES", 0.05)
    rows = corpus(8, 120)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for local in (0, 1, 3):
        found = suffixes.remove_repeats(frame, page_bytes=20_000, local=local)
        assert sorted(map(tuple, found.collect()), key=str) == by_hand(rows)
