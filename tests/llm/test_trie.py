import hashlib
import random
import zlib
from collections import defaultdict

from ledgerlane.llm import trie
from ledgerlane.llm.common import written

SCHEMA = "conv_id long, turn long, role string, text string, depth long, size string, chunk int"


def plain(rows, borrowed=True):
    """Every node from a dictionary of whole prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, sha, role, text))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if borrowed else 0
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members, children, below = defaultdict(list), defaultdict(list), {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    for path in sorted(members, key=len, reverse=True):
        saved = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        below[path] = (
            sum(below[k][0] for k in children[path]) or 1, saved + sum(below[k][1] for k in children[path])
        )
    out = []
    for path, m in members.items():
        ids = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(ids.encode()).hexdigest()
        out.append((min(m), len(path), parent, len(m), len(children[path]), *below[path], digest))
    return sorted(out, key=str)


def found(spark, rows, borrowed=True):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    if not borrowed:
        return sorted((tuple(r) for r in trie.prefixes(frame).collect()), key=str)
    turns = written(trie.ordered(frame), "turns")
    return sorted((tuple(r) for r in trie.trie(*trie.with_borrowed_heads(turns)).collect()), key=str)


def conversations(seed, n, deepest=9, words=2):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(700), n):
        for t in range(rnd.randint(1, deepest)):
            rows.append((c, t, rnd.choice(["user", "bot"]) if t % 2 else "user", "é" * rnd.randint(0, words)))
    rnd.shuffle(rows)
    return rows


def test_borrowed_heads_against_whole_prefixes(spark):
    rows = conversations(1, 300)
    assert found(spark, rows) == plain(rows)


def test_tables_without_a_shared_turn_and_with_long_equal_conversations(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in range(5) for t in range(c + 1)]
    rows += [(c, t, "user", f"{t}") for c in (10, 11, 12) for t in range(12)] + [(12, 50, "bot", "end")]
    assert found(spark, rows, borrowed=False) == plain(rows, borrowed=False)
    apart = [(c, t, "user", f"{c}") for c in range(5) for t in range(3)]
    assert found(spark, apart, borrowed=False) == plain(apart, borrowed=False)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, None, "user", "x"), (1, 0, "user", ""), (2, None, "", ""), (2, 7, "user", "x" * 300_000),
        (3, 1, "user", "same"), (3, 1, "user", "same"), (3, 1, "bot", "tie"), (4, 1, "user", "same"), (None, 0, "user", "lost"),
        (200, 0, "user", "a"), (201, 0, "user", "b"), (202, 0, "us", "era"), (203, -(2**62), "use", "ra"), (203, 2**62, None, "z"),
    ]
    for borrowed in (True, False):
        assert found(spark, rows, borrowed) == plain(rows, borrowed)
    # conversations whose base is absent or shorter may have no turn at all
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in found(spark, rows))
    assert found(spark, []) == [] and found(spark, [(None, 0, "user", "lost")], borrowed=False) == []


def test_role_and_text_are_not_run_together(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, None, "abc"), (4, 0, "", "abc")]
    assert [r[3] for r in found(spark, rows, borrowed=False) if r[1] == 1] == [1, 1, 2]


def test_one_long_conversation_is_cut_into_chunks(spark):
    # 5,000 turns of one conversation; rounds are as many as the deepest shared depth, here two
    rows = [(1, t, "user", str(t)) for t in range(5000)] + [(2, 0, "user", "0"), (2, 1, "user", "1"), (3, 0, "user", "0")]
    assert found(spark, rows, borrowed=False) == plain(rows, borrowed=False)


def test_many_conversations_end_at_one_node(spark):
    rows = [(c, t, "user", "hot" * t) for c in range(-2500, 2500) for t in range(2)] + [(9000, 0, "user", "")]
    assert found(spark, rows, borrowed=False) == plain(rows, borrowed=False)
