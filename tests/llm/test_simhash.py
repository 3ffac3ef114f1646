import random
import re

import xxhash

from ledgerlane.llm import common, simhash


def by_hand(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    value = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s.encode(), 42) >> bit & 1 for s in shingles)
        value |= (2 * ones > len(shingles)) << bit
    return value


def test_fingerprints_match_the_definition():
    dice = random.Random(2)
    pool = ["The", "cat", "sat", "é", " x", "ON", "it\x1f", "Ünder"]
    for text in ["", " ", "one", "a b", *(" ".join(dice.choices(pool, k=dice.randrange(30))) for _ in range(60))]:
        assert simhash.fingerprint_of(text) % (1 << 64) == by_hand(text)


def classes(values, bits):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    ordered = sorted(parent)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if bin((a ^ b) % (1 << 64)).count("1") <= bits:
                parent[root(b)] = root(a)
    found = {}
    for v in ordered:
        found.setdefault(root(v), set()).add(v)
    return sorted(map(sorted, found.values()))


def test_links_join_exactly_what_is_near(spark):
    dice = random.Random(9)
    values = {0, -1}
    for _ in range(40):
        base = dice.getrandbits(64)
        for _ in range(dice.randrange(1, 12)):
            for _ in range(dice.randrange(4)):
                base ^= 1 << dice.randrange(64)
            values.add(base - (1 << 64) if base >> 63 else base)
    # a crowd inside one byte: many fingerprints that share seven bytes
    values |= {dice.getrandbits(8) << 16 for _ in range(60)}
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "simhash long")
    for bits in (0, 1, 2):
        pairs = simhash.links(frame, bits)
        assert all(bin((r["a"] ^ r["b"]) % (1 << 64)).count("1") <= bits for r in pairs.collect())
        joined = {}
        for r in common.components(pairs).collect():
            joined.setdefault(r["component"], set()).add(r["node"])
        alone = [[v] for v in values if not any(v in s for s in joined.values())]
        assert sorted([*map(sorted, joined.values()), *alone]) == classes(values, bits)


def test_small_postings_meet_in_pairs_and_only_large_ones_in_entries(spark, monkeypatch):
    # 40 pairs a bit apart, and a crowd of 60 in one byte, where nothing but entries keeps rows in proportion
    dice = random.Random(12)
    bases = [dice.getrandbits(62) for _ in range(40)]
    crowd = [k << 16 for k in range(60)]
    frame = spark.createDataFrame([(v,) for v in [*bases, *(b ^ 4 for b in bases), *crowd]], "simhash long")
    made = []
    whole = simhash.entries
    monkeypatch.setattr(simhash, "entries", lambda met, bits: made.append(whole(met, bits)) or made[-1])
    for bits in (1, 2):
        made.clear()
        pairs = {frozenset(r) for r in simhash.links(frame, bits).collect()}
        assert {frozenset((b, b ^ 4)) for b in bases} <= pairs
        assert {r["simhash"] for r in made[0].select("simhash").collect()} == set(crowd)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(100)] + [(5000, 5000), (None, 3)]
    dice = random.Random(1)
    dice.shuffle(edges)
    found = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {found[k] for k in range(201)} == {0} and {found[1000 + k] for k in range(100)} == {1000}
    assert 5000 not in found
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_with_nulls_repeats_and_clashing_columns(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta " * 30
    rows = [(5, text), (3, text), (3, text), (None, text), (7, None), (8, ""), (9, "lonely words here"), (None, "none at all")]
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, simhash string, component long")
    found = sorted([(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(frame).collect()], key=str)
    wanted = [(5, 3), (3, 3), (3, 3), (None, 3), (7, 7), (8, 7), (9, 9), (None, None)]
    assert found == sorted(wanted, key=str)
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_components_of_hubs_at_either_end(spark):
    # one node with nearly all edges, as the largest and as the smallest one, beside chains and null ends
    for hub in (10**9, -(10**9)):
        edges = [(hub, k) for k in range(3000)] + [(5000 + k, 5001 + k) for k in range(20)] + [(None, 3), (4, None)]
        found = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
        least = min(hub, 0)
        assert found == {**{k: least for k in range(3000)}, hub: least, **{5000 + k: 5000 for k in range(21)}}
