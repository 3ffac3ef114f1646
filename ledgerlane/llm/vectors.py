"""Embedding near-duplicates by collision counting over many one-dimensional projections.

Every vector is projected on random lines. Two vectors collide on a line if their projections lie within one window
centred on either; near ones collide on most lines, so pairs with at least `least` collisions are verified by their cosine
in double precision. Window and count are set from the threshold: a pair right at it passes with probability `recall`.

Which pairs are counted at all is dealt by cells. A table of cells draws further random directions; a vector's cell is the
one it points along most, or against. Tables are as many as a pair right at the threshold needs to share a cell in one of
them but for `UNMET` of the misses that `recall` allows; a label of few vectors is one cell of one table. Tables are taken
one after another, so the disk holds the vectors dealt by one table at a time. A pair is counted in the first table where
it shares a cell, and a cell of more than `PIECE` vectors is cut into pieces that meet two by two, each such tile in a task.
In a tile the projections of every line are sorted, and the windows around all queries become rows of bits, which are
counted 64 candidates at once. A tile returns counts and each group of its links as a star, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import components, scratch, shuffles_dropped, written

LINES = 24
RECALL = 0.999
#: Half window in standard deviations of the difference of two projections right at the threshold.
REACH = 2.5
#: Of the misses that the recall allows, the share left to pairs that never share a cell.
UNMET = 0.01
#: Vectors of a cell or piece that one task holds; cells are drawn for a quarter of them.
PIECE = 32768
#: Vectors of a side of one count within a tile: its bits stay in the processor's cache.
SIDE = 1024
#: What sending a vector to a cell costs, and drawing one direction for it, in pairs counted (measured: 20 us, 8 ns, 4 ns).
SENT, DRAWN = 4500, 2
#: Directions of a draw, and draws of a table; all of them make 134 million cells.
MOST_DIRECTIONS, MOST_DRAWS = 256, 3
#: From this share of linked pairs on, cosines of a count come from one product.
DENSE = 1 / 32
SEED = 20


def directions(size: int, lines: int = LINES) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((lines, size))


def calibrated(threshold: float, lines: int, recall: float, reach: float = REACH) -> tuple[float, int]:
    """(half window, least collisions) for unit vectors: at the threshold a pair passes with probability `recall`."""
    window = reach * math.sqrt(max(2 - 2 * threshold, 1e-9))
    hit = 2 * NormalDist().cdf(reach) - 1
    tail = 0.0
    for least in range(lines, -1, -1):
        tail += math.comb(lines, least) * hit**least * (1 - hit) ** (lines - least)
        if tail >= recall:
            return window, least
    return window, 0


@lru_cache(maxsize=None)
def meeting(threshold: float, drawn: int) -> float:
    """How likely two unit vectors right at the threshold point most along the same of `drawn` directions, or against it.

    Their products with a random direction are two normal numbers whose correlation is the cosine, whatever the length.
    """
    if drawn == 1:
        return 1 - math.acos(threshold) / math.pi
    across = np.linspace(-6, 6, 481)
    step, middle = across[1] - across[0], len(across) // 2
    a, b = np.meshgrid(across, across, indexing="ij")
    rest = 1 - threshold**2
    density = np.exp(-(a * a - 2 * threshold * a * b + b * b) / (2 * rest)) / (2 * math.pi * math.sqrt(rest)) * step**2
    sums = np.zeros((len(across) + 1, len(across) + 1))
    sums[1:, 1:] = density.cumsum(0).cumsum(1)
    k = np.arange(middle + 1)
    low, high = middle - k, middle + k + 1
    # how likely another direction stays below both, halfway between the grid's rectangles
    inside = sums[np.ix_(high, high)] - sums[np.ix_(low, high)] - sums[np.ix_(high, low)] + sums[np.ix_(low, low)]
    inside[1:, 1:] = (inside[1:, 1:] + inside[:-1, 1:] + inside[1:, :-1] + inside[:-1, :-1]) / 4
    inside[0], inside[:, 0] = 0, 0
    return float(2 * drawn * (density[middle:, middle:] * np.clip(inside, 0, 1) ** (drawn - 1)).sum())


@lru_cache(maxsize=4096)
def dealing(alike: int, threshold: float, missed: float, piece: int = PIECE) -> tuple[int, int, int]:
    """(tables, draws a table, directions a draw) for `alike` vectors that may all meet: the cheapest, with `missed` at most.

    A cell is what all draws of its table say. Without a draw all vectors are one cell.
    """
    best = (SENT + alike / 2 if alike <= piece else math.inf, (1, 0, 0))
    # a higher cosine meets more often, so the bound holds for thresholds nearer to 1 as well
    threshold = min(max(threshold, 1e-3 - 1), 1 - 1e-3)
    for draws in range(1, MOST_DRAWS + 1):
        drawn = 1 if draws == 1 else MOST_DIRECTIONS // 16
        while drawn <= MOST_DIRECTIONS:
            tables = math.ceil(math.log(missed) / math.log1p(-(meeting(threshold, drawn) ** draws)))
            cell = alike / (2 * drawn) ** draws
            cost = tables * (SENT + DRAWN * drawn * draws + cell / 2)
            if cell <= piece / 4 or drawn == MOST_DIRECTIONS and draws == MOST_DRAWS:
                best = min(best, (cost, (tables, draws, drawn)))
            drawn *= 2
    return best[1]


@lru_cache(maxsize=256)
def drawn_directions(size: int, table: int, draw: int, drawn: int) -> np.ndarray:
    return np.random.default_rng([SEED, table, draw, size]).standard_normal((drawn, size)).astype(np.float32).T


def cells(units: np.ndarray, tables: int, draws: int, drawn: int) -> np.ndarray:
    """The cell of each unit vector (row) in each table (column)."""
    out = np.zeros((len(units), tables), "<i4")
    units = units.astype(np.float32)
    rows = np.arange(len(units))
    for table in range(tables if draws else 0):
        for draw in range(draws):
            along = units @ drawn_directions(units.shape[1], table, draw, drawn)
            most = np.abs(along).argmax(axis=1)
            out[:, table] = out[:, table] * (2 * drawn) + 2 * most + (along[rows, most] < 0)
    return out


def unit_rows(packed: pa.Array, size: int) -> np.ndarray:
    """Unit vectors in double precision of vectors packed as bytes, none null, all with `size` components."""
    width = pc.binary_length(packed[:1])[0].as_py() // size
    start = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset]
    found = np.frombuffer(packed.buffers()[2], f"<f{width}", len(packed) * size, int(start)).reshape(-1, size).astype(np.float64)
    found /= np.abs(found).max(axis=1, keepdims=True)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def ordered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of every line (row of the results) of projections, a row per vector, and the projections in it."""
    lines = np.ascontiguousarray(values.T)
    order = np.argsort(lines, axis=1)
    return order, np.take_along_axis(lines, order, axis=1)


def prefixes(order: np.ndarray) -> np.ndarray:
    """Row k has the bits of the first k candidates of a line's order."""
    bits = np.zeros((len(order) + 1, -(-len(order) // 64)), np.uint64)
    bits[np.arange(1, len(order) + 1), order >> 6] = np.uint64(1) << (order & 63).astype(np.uint64)
    return np.bitwise_xor.accumulate(bits, axis=0, out=bits)


def windows(order: np.ndarray, queries: np.ndarray, others: np.ndarray, window: float) -> tuple[np.ndarray, np.ndarray]:
    """From where to where in the line's sorted candidates the window around each query reaches; queries come in `order`."""
    low, high = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    low[order] = np.searchsorted(others, queries - window, side="left")
    high[order] = np.searchsorted(others, queries + window, side="right")
    return low, high


def collisions(queries: np.ndarray, others: np.ndarray, window: float) -> np.ndarray:
    """How many lines each query (row) and candidate (column) collide on; arguments are projections, a row per vector."""
    total = np.zeros((len(queries), len(others)), np.int16)
    (order, sorted_queries), (other_order, sorted_others) = ordered(queries), ordered(others)
    for line in range(queries.shape[1]):
        bits = prefixes(other_order[line])
        low, high = windows(order[line], sorted_queries[line], sorted_others[line], window)
        total += flags(bits[high] ^ bits[low], len(others))
    return total


def flags(bits: np.ndarray, n: int) -> np.ndarray:
    """Bits of rows as zeros and ones, n columns."""
    return np.unpackbits(bits.astype("<u8", copy=False).view(np.uint8), axis=1, count=n, bitorder="little")


def places(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the bits that are set."""
    words = np.flatnonzero(bits)
    word, bit = np.nonzero(flags(bits.ravel()[words, None], 64).view(bool))
    return words[word] // bits.shape[1], words[word] % bits.shape[1] * 64 + bit


class Side:
    """Up to SIDE vectors of a tile: their projections in the order of every line, their cells in earlier tables."""

    def __init__(self, start: int, units: np.ndarray, lines: np.ndarray, earlier: np.ndarray):
        self.start, self.units, self.size, self.earlier = start, units, len(units), earlier
        self.order, self.sorted = ordered(units @ lines.T)
        #: the cell that all of them share, by table
        self.shared = np.where((earlier == earlier[:1]).all(axis=0), earlier[0], -1)

    def met(self, other: Side) -> bool:
        """Whether an earlier table has all of both in one cell."""
        return bool(((self.shared == other.shared) & (self.shared >= 0)).any())


def colliding(others: Side, queries: list[Side], window: float, least: int) -> Iterator[tuple[Side, np.ndarray]]:
    """(queries, bits): which pairs collide on `least` lines or more. If `others` are among `queries`, each of their pairs comes once."""
    bits = [prefixes(order) for order in others.order]
    missable = len(bits) - least
    full = prefixes(np.arange(others.size))
    for side in queries:
        open_ = np.repeat(full[-1:], side.size, axis=0)
        if side is others:
            open_ ^= full[1:]
        # within[k]: pairs that missed k lines or fewer so far
        within = [open_.copy() for _ in range(missable + 1)]
        hit, start = np.empty_like(open_), np.empty_like(open_)
        for line, held in enumerate(bits):
            low, high = windows(side.order[line], side.sorted[line], others.sorted[line], window)
            np.take(held, high, axis=0, out=hit, mode="clip")
            np.take(held, low, axis=0, out=start, mode="clip")
            hit ^= start
            for k in range(missable, 0, -1):
                if k <= line:
                    within[k] &= hit
                    within[k] |= within[k - 1]
            within[0] &= hit
        if within[missable].any():
            yield side, within[missable]


class Groups:
    """Union-find over the vectors of a tile; `name` is the same number for all vectors of a group."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.name = np.arange(n)

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.name[a] != self.name[b]
        if not apart.any():
            return
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            self.parent[self.root(x)] = self.root(y)
        name, above = None, np.array(self.parent)
        while name is None or (name != above).any():
            name, above = above, above[above]
        self.name = name

    def join_linked(self, linked: np.ndarray, a: int, b: int) -> None:
        """The same for a table of flags; its rows are vectors from a on, its columns from b on."""
        rows, columns = linked.shape
        x, y = np.arange(a, a + rows), np.arange(b, b + columns)
        while True:
            p, q = self.name[x], self.name[y]
            if p.min() == p.max() == q.min() == q.max():
                return
            apart = linked & (p[:, None] != q)
            of_row, of_column = apart.any(axis=1), apart.any(axis=0)
            if not of_row.any():
                return
            self.join(x[of_row], b + apart[of_row].argmax(axis=1))
            self.join(a + apart[:, of_column].argmax(axis=0), y[of_column])


def links_of_tile(units: np.ndarray, weights: np.ndarray, earlier: np.ndarray, cut: int, lines: np.ndarray, window: float,
                  least: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights linked to each vector, its group): of pairs of all vectors, or if `cut` is less of those before it and after.

    Pairs that shared a cell in an earlier table (columns of `earlier`) are left out.
    """
    found, groups = np.zeros(len(units)), Groups(len(units))
    weights = weights.astype(np.float64)
    ranges = [(k, min(k + SIDE, end)) for begin, end in ((0, cut), (cut, len(units))) for k in range(begin, end, SIDE)]
    sides = [Side(a, units[a:b], lines, earlier[a:b]) for a, b in ranges]
    for k, others in enumerate(sides):
        queries = sides[k:] if cut == len(units) else [s for s in sides if s.start < cut <= others.start]
        queries = [s for s in queries if not s.met(others)]
        for side, bits in colliding(others, queries, window, least) if queries else ():
            a, b = slice(side.start, side.start + side.size), slice(others.start, others.start + others.size)
            if np.bitwise_count(bits).sum() > DENSE * side.size * others.size:
                linked = (side.units @ others.units.T >= threshold) & flags(bits, others.size).view(bool)
                for x, y in zip(side.earlier.T, others.earlier.T):
                    linked &= x[:, None] != y
                if linked.any():
                    counted = linked.astype(np.float64)
                    found[a] += counted @ weights[b]
                    found[b] += weights[a] @ counted
                    groups.join_linked(linked, a.start, b.start)
                continue
            x, y = places(bits)
            keep = np.einsum("ij,ij->i", side.units[x], others.units[y]) >= threshold
            x, y = x[keep], y[keep]
            new = ~(side.earlier[x] == others.earlier[y]).any(axis=1)
            x, y = x[new], y[new]
            if len(x):
                found[a] += np.bincount(x, weights[b][y], side.size)
                found[b] += np.bincount(y, weights[a][x], others.size)
                groups.join(x + a.start, y + b.start)
    return found, groups.name


def usable(embedding: str) -> Column:
    """Not null, with finite components, not all zero."""
    return F.expr(
        f"`{embedding}` IS NOT NULL AND size(`{embedding}`) > 0 AND forall(`{embedding}`, x -> x IS NOT NULL AND NOT isnan(x)"
        f" AND abs(x) < double('infinity')) AND exists(`{embedding}`, x -> x <> 0)"
    )


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, lists of numbers without a null among them, as their bytes."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        numbers = lists.flatten().to_numpy(zero_copy_only=False)
        numbers = np.ascontiguousarray(numbers, numbers.dtype.newbyteorder("<"))
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]) * numbers.itemsize
        packed = pa.Array.from_buffers(
            pa.binary(), len(lists), [lists.is_valid().buffers()[1], pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(numbers)]
        )
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=batch.schema.names)


def tiles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one tile after another, of rows sorted by `tile`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        tile = batch.column("tile").to_numpy()
        if not len(tile):
            continue
        starts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
        if held and held[0].column("tile")[0].as_py() != tile[0]:
            yield pa.Table.from_batches(held)
            held = []
        for start, end in zip(starts, starts[1:]):
            if start:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                    threshold: float = 0.93, lines: int = LINES, recall: float = RECALL, piece: int = PIECE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: vectors of one label with a cosine of `threshold` or more.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with
    nothing. Vectors of different lengths never link. Equal vectors of a label stand for one class in the search and
    count as links of each other; a repeated vec_id counts as a vector of its own per row and reports once per row. A
    null vec_id links like any other and never gives a component its name unless all ids are null.
    """
    spark = rows.sparkSession
    # single precision is kept as it is, all else in double precision
    given, width = ("array<float>", 4) if dict(rows.dtypes)[embedding] == "array<float>" else ("array<double>", 8)
    base = rows.select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"),
        F.when(usable(embedding) & F.col(label).isNotNull(), F.col(embedding).cast(given)).alias("v"),
    )
    base = base.select("vec_id", "label", F.when(F.col("v").isNotNull(), F.xxhash64("v", "label")).alias("copy"), "v")
    kinds = dict(base.dtypes)
    missed = (1 - recall) * UNMET
    window, least = calibrated(threshold, lines, recall + missed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, alike = (batch.column(name).to_numpy() for name in ("size", "alike"))
            out: list = [None] * len(size)
            for s, n in np.unique(np.stack([size, alike], axis=1), axis=0).tolist():
                of = np.flatnonzero((size == s) & (alike == n))
                found = cells(unit_rows(batch.column("v").take(pa.array(of)), s), *dealing(n, threshold, missed, piece))
                for k, row in zip(of.tolist(), found):
                    out[k] = row.tobytes()
            names = ["copy", "label", "size", "n", "least_id", "v"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(out, pa.binary())], names=[*names, "cells"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in tiles_of(batches):
            half = tile.column("half").to_numpy()
            if len(half) < 2 or half.min() == half.max() < 2:
                continue
            order = np.argsort(half, kind="stable")
            size = tile.column("size")[0].as_py()
            earlier = np.frombuffer(b"".join(tile.column("earlier").to_pylist()), "<i4").reshape(len(half), -1)
            # vectors that met before side by side: whole blocks of pairs are then left out
            order = order[np.lexsort([*earlier[order].T[::-1], half[order]])]
            tile = tile.combine_chunks().take(pa.array(order))
            copy = tile.column("copy").to_numpy()
            cut = len(half) if half.max() == 2 else int((half == 0).sum())
            found, group = links_of_tile(
                unit_rows(tile.column("v").combine_chunks(), size), tile.column("n").to_numpy(), earlier[order], cut,
                directions(size, lines), window, least, threshold,
            )
            some = np.flatnonzero(found)
            if len(some):
                # a group as a star around its least copy
                least_copy = np.full(len(copy), np.iinfo(np.int64).max)
                np.minimum.at(least_copy, group, copy)
                centre = least_copy[group]
                outer = copy != centre
                columns = [
                    np.concatenate([copy[some], centre[outer]]),
                    np.concatenate([np.zeros(len(some), np.int64), copy[outer]]),
                    np.concatenate([found[some].astype(np.int64), np.full(outer.sum(), -1)]),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "found"])

    with shuffles_dropped(spark):
        keyed = written(
            base.mapInArrow(pack, f"vec_id {kinds['vec_id']}, label {kinds['label']}, copy long, v binary"), "vectors"
        ).withColumn("size", (F.length("v") / width).cast("int"))
        there = keyed.where("v IS NOT NULL")
        alike = there.select("copy", "label", "size").distinct().groupBy("label", "size").agg(F.count(F.lit(1)).alias("alike"))
        alike = written(alike, "alike")
        classes = there.groupBy("copy", "label", "size").agg(
            F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least_id")
        )
        dealt = written(
            classes.join(alike, ["label", "size"]).mapInArrow(
                deal, f"copy long, label {kinds['label']}, size int, n long, least_id {kinds['vec_id']}, v binary, cells binary"
            ), "dealt",
        )
        tables = (dealt.agg(F.max(F.length("cells"))).first()[0] or 4) // 4
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = scratch(spark, "links")
        for table in range(tables):
            placed = dealt.where(F.length("cells") > 4 * table).withColumn(
                "cell", F.xxhash64("label", "size", F.substring("cells", 4 * table + 1, 4))
            )
            crowded = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / piece).alias("pieces")).where("pieces > 1")
            pieces = F.coalesce("pieces", F.lit(1))
            pairs = (
                placed.join(written(crowded, "crowded"), "cell", "left")
                .withColumn("piece", F.pmod(F.xxhash64("copy", "cell"), pieces))
                .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
                .select(
                    F.xxhash64("cell", F.least("piece", "other"), F.greatest("piece", "other")).alias("tile"),
                    F.expr("CASE WHEN piece = other THEN 2 WHEN piece < other THEN 0 ELSE 1 END").alias("half"),
                    "copy", "n", "size", F.substring("cells", 1, 4 * table).alias("earlier"), "v",
                )
                .repartition(tasks, "tile").sortWithinPartitions("tile")
            )
            pairs.mapInArrow(compare, "a long, b long, found long").write.mode("append").parquet(path)
    results = spark.read.schema("a long, b long, found long").parquet(path)
    counted = results.where("found >= 0").groupBy(F.col("a").alias("copy")).agg(F.sum("found").alias("found"))
    reached = components(results.where("found < 0").select("a", "b")).withColumnRenamed("node", "copy")
    joined = (
        dealt.select("copy", "n", "least_id").join(counted, "copy", "left").join(reached, "copy", "left")
        .withColumn("component", F.coalesce("component", "copy"))
    )
    first = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = joined.join(first, "component").select(
        "copy", (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    linked = keyed.select("vec_id", "copy").join(named, "copy", "left")
    component = F.when(F.col("copy").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return linked.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
