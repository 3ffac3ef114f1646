import zlib
from collections import Counter

from ledgerlane.llm import sharding


def rows_of(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, shard int")
    return sharding.assign(frame, sharding.even_tree(8), grown=sharding.even_tree(9), **options).collect()


def test_slots_sizes_and_growth(spark):
    rows = [(k, "é" * (k % 7)) for k in range(3000)] + [(None, None), (5, "é" * 5), (5, "other")]
    found = rows_of(spark, rows)
    assert len(found) == len(rows)
    for shard in range(8):
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots))) and len(slots) > 250
    moved = [r for r in found if r["grown_shard"] != r["shard"]]
    assert {r["grown_shard"] for r in moved} == {8} and 200 < len(moved) < 480
    for r in found:
        text = next(t for d, t in rows if d == r["doc_id"] and zlib.crc32((t or "").encode()) == r["text_crc32"])
        assert r["size"] == len((text or "").encode()) + 1 and r["law"] == "key"
    assert len({r["shard"] for r in found if r["doc_id"] == 5}) == 1
    assert rows_of(spark, rows, buckets=3) != [] and rows_of(spark, []) == []


def test_only_subtrees_with_changed_weights_move(spark):
    frame = spark.createDataFrame([(k, "") for k in range(4000)], "doc_id long, text string")
    tree = sharding.even_tree(8)
    heavier = [sharding.Leaf(l.shard, l.rack, l.region, 3.0 if l.shard == 7 else 1.0) for l in tree]
    pairs = Counter((r["shard"], r["grown_shard"]) for r in sharding.assign(frame, tree, grown=heavier).collect())
    moved = [p for p in pairs if p[0] != p[1]]
    # region 0 only loses; inside region 1 rack 2 only loses to rack 3; inside rack 3 shard 6 only loses to shard 7
    assert not [p for p in moved if p[1] < 4 or (p[0] >= 4 and p[1] < 6) or p == (7, 6)]
    share = sum(n for (_, now), n in pairs.items() if now == 7) / 4000
    assert abs(share - (6 / 10) * (4 / 6) * (3 / 4)) < 0.04


def test_weights_draw_in_proportion(spark):
    frame = spark.createDataFrame([(k, "") for k in range(6000)], "doc_id long, text string")
    tree = [sharding.Leaf(0, "a", "x", 1.0), sharding.Leaf(1, "b", "x", 2.0), sharding.Leaf(2, "c", "y", 3.0)]
    counts = Counter(r["shard"] for r in sharding.assign(frame, tree).collect())
    assert abs(counts[0] - 1000) < 150 and abs(counts[1] - 2000) < 200 and abs(counts[2] - 3000) < 200
