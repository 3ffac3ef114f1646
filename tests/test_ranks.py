"""Areas under the curve by ranges and exact shares by counting, against plain sorting."""

import random
from collections import Counter

import pytest

from ledgerlane.operators import ranks


def plain_auc(rows):
    good, bad = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    wins = sum((g > b) + (g == b) / 2 for g in good for b in bad)
    return len(good), len(bad), round(wins / (len(good) * len(bad)), 9)


@pytest.mark.parametrize("ranges", [1, 2, 16, 256])
def test_area_with_ties_and_a_hot_score(spark, ranges):
    rnd = random.Random(ranges)
    rows = [(rnd.randint(0, 1), rnd.random() if rnd.random() < 0.6 else 0.25) for _ in range(900)]
    rows += [(1, -3.0), (0, 1e300), (0, -1e300), (1, 0.25 + 2**-54)]
    frame = spark.createDataFrame(rows, "y int, s double").repartition(5)
    assert tuple(ranks.auc_by_ranges(frame, "y", "s", ranges).first()) == plain_auc(rows)


def test_area_leaves_out_rows_without_label_or_score(spark):
    rows = [(1, 0.5), (0, 0.25), (None, 0.1), (1, None), (0, float("nan")), (2, 0.9)]
    assert tuple(ranks.auc_by_ranges(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()) == (1, 1, 1.0)
    for rows in ([], [(1, 0.5)], [(0, 0.5), (0, 0.7)]):
        found = ranks.auc_by_ranges(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
        assert found.auc is None and found.n_good == sum(y for y, _ in rows)


def test_no_stage_orders_all_scores(spark):
    rows = spark.range(50_000).selectExpr("id % 2 AS y", "rand(7) AS s")
    plan = ranks.auc_by_ranges(rows, "y", "s")._jdf.queryExecution().executedPlan().toString()
    # one row per range is all that meets in a single task
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("normalizenanandzero(range#" in line for line in windows)


def rows_of(spark, sizes, seed=1):
    rows = [(f"{label}{k}", label) for label, n in sizes.items() for k in range(n)]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, "k string, y string")


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 4, "b": 5}, {"a": 997, "b": 13, "c": 20_000}])
@pytest.mark.parametrize("share", [0.8, 0.5, 0.01])
def test_shares_are_exact_and_do_not_depend_on_partitions(spark, sizes, share):
    frame = rows_of(spark, sizes)
    chosen = frame.where(ranks.in_share(frame, "k", "y", share)).collect()
    assert Counter(r.y for r in chosen) == Counter({y: int(n * share + 1e-9) for y, n in sizes.items()})
    other = rows_of(spark, sizes, 2).repartition(7)
    assert sorted(other.where(ranks.in_share(other, "k", "y", share)).collect()) == sorted(chosen)


def test_few_bits_a_pass_descend_to_the_last(spark, monkeypatch):
    monkeypatch.setattr(ranks, "DIGIT", 3)
    frame = rows_of(spark, {"a": 700, "b": 300})
    chosen = frame.where(ranks.in_share(frame, "k", "y")).collect()
    assert Counter(r.y for r in chosen) == {"a": 560, "b": 240}


def test_shares_of_odd_rows(spark):
    frame = spark.createDataFrame([("x", "a")] * 9 + [("y", "a"), (None, "a"), ("z", None)], "k string, y string")
    chosen = frame.where(ranks.in_share(frame, "k", "y", 0.8)).collect()
    # nine rows of one key stay together; the row without a label is in no share
    assert len(chosen) <= 8 and all(r.y == "a" for r in chosen)
    empty = frame.limit(0)
    assert empty.where(ranks.in_share(empty, "k", "y")).count() == 0
