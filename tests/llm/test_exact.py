import hashlib
import random

from pyspark.sql import functions as F

from ledgerlane.llm import exact

SCHEMA = "doc_id long, text string, kept string, row long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)


def plain(rows):
    """(doc_id, keep_id, group_size, digest) of every row by a dictionary of normalised texts."""
    groups = {}
    for doc, text in rows:
        groups.setdefault((text or "").translate({c: None for c in b" \t\n\x0b\x0c\r"}), []).append((doc, text or ""))
    out = []
    for bare, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        out += [(m[0], best[0], len(members), hashlib.sha256(bare.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def checked(spark, rows):
    found = exact.groups(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == plain(rows)
    kept = [r for r in found if r.kept]
    # one row of each group stays, and it carries the id that the group keeps
    assert len(kept) == len({r.text_sha256 for r in found}) and all(r.doc_id == r.keep_id for r in kept)
    return found


def test_odd_rows(spark):
    long = "word " * 200_000
    checked(
        spark,
        [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a b"), (5, "ab"), (6, "a b"), (7, "A b"), (None, "a  b"),
         (None, "xy"), (8, "x y"), (9, "x\ty"), (9, "x\ty"), (10, long), (11, long + " "), (12, "é"), (13, "é"), (None, None)],
    )
    assert exact.groups(frame(spark, [])).collect() == []


def test_equal_rows_keep_exactly_one(spark):
    found = checked(spark, [(5, "same text")] * 40 + [(None, "nobody")] * 3 + [(5, "same  text")])
    assert sum(r.kept for r in found) == 2 and len(found) == 44


def test_heavy_hitters_and_the_rest_agree_with_brute_force(spark):
    rnd = random.Random(3)
    common = ["the one", "t heone", "other", "third thing"]
    rows = [(k, rnd.choice(common) + " " * rnd.randint(0, 4) if k % 3 else f"text {rnd.randint(0, 9000)}") for k in range(20_000)]
    checked(spark, rows)
    heavy = exact.winners(exact.digests(frame(spark, rows))).collect()
    # only digests in over one in 1,024 rows are broadcast, with their exact size
    sizes = {r[3]: r[2] for r in plain(rows)}
    assert {r.heavy: r.group_size for r in heavy} == {d: n for d, n in sizes.items() if n * exact.SHARE > len(rows)}


def test_heavy_hitters_are_not_shuffled(spark):
    rows = frame(spark, [(k, "one text") for k in range(3000)] + [(-k, f"text {k}") for k in range(1, 500)])
    out = exact.groups(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastHashJoin") == 2
    for operator in ("Python", "InPandas", "CartesianProduct", "NestedLoop"):
        assert operator not in plan
    assert out.where("group_size = 3000").count() == 3000


def test_the_summary_finds_every_heavy_hitter(spark):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 900 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text_sha256")
    ).repartition(16)
    found = {r.item for r in exact.frequent(rows).collect()}
    hot = spark.range(1).select(F.xxhash64(F.lit("hot"))).first()[0]
    assert hot in found and len(found) <= exact.CANDIDATES


def test_documents_that_stay(spark):
    rows = [(1, "a b"), (2, "a  b"), (2, "a  b"), (2, "ab"), (3, "c"), (None, "c"), (4, None)]
    kept = exact.without_copies(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "kept", "row"]
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, "a  b"), (3, "c"), (4, None)]
