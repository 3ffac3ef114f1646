import math
from pathlib import Path

import numpy as np

from ledgerlane.llm import vectors
from ledgerlane.llm.common import scratch


def by_hand(rows, threshold):
    def unit(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, float)
        return a / np.linalg.norm(a)

    units = [unit(r[1]) if r[2] is not None else None for r in rows]
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if units[i] is None or units[j] is None or rows[i][2] != rows[j][2] or len(units[i]) != len(units[j]):
                continue
            if units[i] @ units[j] >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(
        ((r[0], links[i], least.get(root(i)), r[0] is not None and r[0] == least.get(root(i))) for i, r in enumerate(rows)),
        key=str,
    )


def sample(seed=1, n=260, size=16):
    dice = np.random.default_rng(seed)
    rows, centres = [], dice.standard_normal((25, size))
    for k in range(n):
        centre = centres[dice.integers(25)]
        spread = dice.choice([0.02, 0.1, 0.2, 0.5])
        vector = (centre + spread * dice.standard_normal(size)).astype(np.float32)
        rows.append((k, [float(x) for x in vector * dice.uniform(0.1, 9)], int(dice.integers(2))))
    rows += [(1000 + k, rows[7][1], rows[7][2]) for k in range(20)]
    rows += [(2000, None, 1), (2001, [0.0] * size, 1), (2002, [float("nan")] * size, 1), (2003, rows[7][1], None),
             (2004, [None] + [1.0] * (size - 1), 1), (2005, [float("inf")] * size, 0), (2006, [], 0), (5, rows[5][1], rows[5][2]),
             (None, rows[9][1], rows[9][2]), (2007, [1.0, 0.0], 0), (2008, [1.0, 0.01], 0)]
    return rows


def test_links_and_components_against_brute_force(spark, monkeypatch):
    rows = sample()
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, copy string")
    exact = [(a, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None, c) for a, v, c in rows]
    found = vectors.near_duplicates(frame, threshold=0.93)
    assert sorted(map(tuple, found.collect()), key=str) == by_hand(exact, 0.93)
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_recall_of_collision_counting_at_the_threshold():
    dice = np.random.default_rng(4)
    window, least = vectors.calibrated(0.93, vectors.LINES, vectors.RECALL)
    lines = vectors.directions(64).T
    near = far = 0
    for _ in range(400):
        a = dice.standard_normal(64)
        a /= np.linalg.norm(a)
        b = dice.standard_normal(64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.93 * a + math.sqrt(1 - 0.93**2) * b
        counts = vectors.collisions((a @ lines)[None], np.stack([c @ lines, b @ lines]), window)[0]
        near += counts[0] >= least
        far += counts[1] >= least
    assert near >= 0.99 * 400 and far < near


def test_collisions_count_lines_within_the_window():
    dice = np.random.default_rng(5)
    a, b = dice.standard_normal((9, 6)), dice.standard_normal((11, 6))
    wanted = (np.abs(a[:, None] - b[None]) <= 0.7).sum(2)
    assert (vectors.collisions(a, b, 0.7) == wanted).all()


def pairs_at_the_threshold(n, size, along=None):
    """2 n vectors, of which k and n + k have a cosine just above 0.93; `along` sets their distance on the first line."""
    dice = np.random.default_rng(9)
    line = vectors.directions(size, 1)[0]
    out = [[], []]
    cosine = 0.9301
    while len(out[0]) < n:
        a = dice.standard_normal(size)
        a /= np.linalg.norm(a)
        b = dice.standard_normal(size)
        b -= (b @ a) * a
        if along:
            # turn the difference so that it covers `along` standard deviations of the first line
            flat = line - (line @ a) * a
            b -= (b @ flat) / (flat @ flat) * flat
            share = (along * math.sqrt(2 - 2 * cosine) + (1 - cosine) * (line @ a)) / math.sqrt(1 - cosine**2) / np.linalg.norm(flat)
            if abs(share) >= 1:
                continue
            b = share * flat / np.linalg.norm(flat) + math.sqrt(1 - share**2) * b / np.linalg.norm(b)
        out[0].append(a)
        out[1].append(cosine * a + math.sqrt(1 - cosine**2) * b / np.linalg.norm(b))
    return np.array(out[0] + out[1])


def links(spark, found):
    frame = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(found)], "vec_id long, embedding array<double>, label int")
    return np.array([r["n_links"] for r in vectors.near_duplicates(frame).orderBy("vec_id").collect()])


def test_pairs_far_apart_on_the_first_line_are_compared(spark):
    found = pairs_at_the_threshold(300, 64, along=4.5)
    apart = (found[300:] - found[:300]) @ vectors.directions(64, 1)[0]
    assert np.allclose(apart, 4.5 * math.sqrt(2 - 2 * 0.9301))
    lines = vectors.directions(64).T
    window, least = vectors.calibrated(0.93, vectors.LINES, vectors.RECALL)
    counted = (np.abs(found[300:] @ lines - found[:300] @ lines) <= window).sum(1) >= least
    assert counted.mean() > 0.95
    assert (links(spark, found)[:300] >= counted).all()


def test_recall_of_the_whole_search_at_the_threshold(spark):
    n = 4000
    found = links(spark, pairs_at_the_threshold(n, 64))
    assert (found[:n] > 0).mean() >= vectors.RECALL


def test_links_and_components_through_many_tables_and_pieces(spark):
    # cells of 5 vectors on average, cut from 20 on: equal vectors and near ones meet in several tables and pieces
    dice = np.random.default_rng(3)
    rows = sample(seed=2, n=300)
    hot = [(3000 + k, (np.arange(16) - 7.5 + 0.3 * dice.standard_normal(16)).astype(np.float32).tolist(), 0) for k in range(90)]
    rows += hot
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    exact = [(a, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None, c) for a, v, c in rows]
    assert vectors.dealing(250, 0.93, 1e-5, 20)[0] > 5
    found = vectors.near_duplicates(frame, threshold=0.93, piece=20)
    assert sorted(map(tuple, found.collect()), key=str) == by_hand(exact, 0.93)


def test_recall_through_tables_at_the_threshold(spark):
    n = 4000
    found = pairs_at_the_threshold(n, 64)
    frame = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(found)], "vec_id long, embedding array<double>, label int")
    assert vectors.dealing(2 * n, 0.93, 1e-5, 400)[0] > 8
    met = vectors.near_duplicates(frame, piece=400).where(f"vec_id < {n} AND n_links > 0").count()
    assert met >= vectors.RECALL * n


def test_tables_miss_no_more_than_set():
    dice = np.random.default_rng(6)
    a = dice.standard_normal((20000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = dice.standard_normal((20000, 64))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    for n in (60_000, 1_500_000, 40_000_000):
        tables, draws, drawn = vectors.dealing(n, 0.93, 1e-5)
        assert tables < 60
        met = vectors.cells(a, tables, draws, drawn) == vectors.cells(b, tables, draws, drawn)
        assert abs(met.mean() - vectors.meeting(0.93, drawn) ** draws) < 0.01
        assert met.any(axis=1).mean() >= 0.9998


def test_links_of_a_tile_against_brute_force(monkeypatch):
    monkeypatch.setattr(vectors, "SIDE", 16)
    dice = np.random.default_rng(8)
    units = dice.standard_normal((5, 12))[dice.integers(5, size=150)] + 0.25 * dice.standard_normal((150, 12))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    weights = dice.integers(1, 4, 150)
    earlier = dice.integers(3, size=(150, 2)).astype("<i4")
    lines = vectors.directions(12)
    window, least = vectors.calibrated(0.93, vectors.LINES, vectors.RECALL)
    every = (units @ units.T >= 0.93) & (vectors.collisions(units @ lines.T, units @ lines.T, window) >= least)
    every &= ~(earlier[:, None] == earlier[None]).any(axis=2)
    for cut, dense in ((150, 0.03), (150, 1), (60, 0.03)):
        monkeypatch.setattr(vectors, "DENSE", dense)
        allowed = ~np.eye(150, dtype=bool) if cut == 150 else (np.arange(150) < cut)[:, None] != (np.arange(150) < cut)
        found, group = vectors.links_of_tile(units, weights, earlier, cut, lines, window, least, 0.93)
        assert found.tolist() == ((every & allowed) @ weights).tolist()
        reached = np.eye(150, dtype=bool) | (every & allowed)
        for _ in range(8):
            reached = reached @ reached
        assert ((group[:, None] == group[None]) == reached).all()


def bytes_in(*folders):
    return sum(p.stat().st_size for f in folders for p in Path(f).rglob("*") if p.is_file())


def test_disk_grows_with_the_vectors_not_with_pairs(spark):
    n, size = 6000, 64
    made = np.random.default_rng(2).standard_normal((n, size)).astype(np.float32)
    frame = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(made)], "vec_id long, embedding array<float>, label int")
    frame.write.parquet(path := scratch(spark, "embeddings"))
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    folders = [spark.sparkContext.getCheckpointDir().removeprefix("file:"), *(d.getPath() for d in local)]
    before = bytes_in(*folders)
    vectors.near_duplicates(spark.read.parquet(path))
    assert bytes_in(*folders) - before < 4 * made.nbytes
