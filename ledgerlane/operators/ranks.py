"""Order statistics without a global order: areas under the curve by ranges, exact shares by counted prefixes."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which scores are cut; what a range totals is one row.
RANGES = 256
#: Bits of a draw that one pass counts, and so 4,096 counters per label at most.
DIGIT = 12


def cut_points(df: DataFrame, score: str, ranges: int = RANGES) -> list[float]:
    """Values that cut the scores into ranges of about equal size, from one pass with a sketch of fixed size."""
    shares = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(score, shares, 100 * ranges)).first()[0]
    return sorted(set(found or []))


def auc_by_ranges(df: DataFrame, label: str, score: str, ranges: int = RANGES) -> DataFrame:
    """Counts of both labels and the exact area under the ROC curve, for scores with any number of different values.

    Equal scores are reduced to one row with both counts, wherever they are. A window then runs inside each range of
    scores; what lies below a range is the sum of the totals of the ranges before it, one row each. ``df`` is read twice.
    Rows without a label or score and scores that are no number are left out; without both labels the area is null.
    """
    # adding zero makes -0.0 and 0.0 one score
    typed = df.select(F.col(label).cast("int").alias("y"), (F.col(score).cast("double") + F.lit(0.0)).alias("s"))
    rows = typed.where(F.col("y").isin(0, 1) & F.col("s").isNotNull() & ~F.isnan("s"))
    # a value at a cut belongs to the range above it, so equal scores share a range; any cut does for few scores
    splits = [-math.inf, *(cut_points(rows, "s", ranges) or [0.0]), math.inf]
    placed = Bucketizer(splits=splits, inputCol="s", outputCol="range").transform(rows)
    per_score = placed.groupBy("range", "s").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad"))
    below = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    whole = "decimal(38,0)"

    def exact(c: str | Column) -> Column:
        return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")

    inside = exact("good") * (exact(F.coalesce(F.sum("bad").over(below), F.lit(0))) * 2 + exact("bad"))
    per_range = (
        per_score.withColumn("twice", inside.cast(whole))
        .groupBy("range")
        .agg(*[F.sum(c).cast(whole).alias(c) for c in ("good", "bad", "twice")])
    )
    zero = F.lit(0).cast(whole)
    totals = per_range.agg(F.array_sort(F.collect_list(F.struct("range", "good", "bad", "twice"))).alias("ranges"))
    start = F.struct(zero.alias("good"), zero.alias("bad"), zero.alias("twice"))

    def passed(held: Column, r: Column) -> Column:
        """One range further: its own pairs, and its good rows with every bad row of the ranges before."""
        across = (exact(r["good"]) * exact(held["bad"]) * 2).cast(whole)
        return F.struct(
            (held["good"] + r["good"]).cast(whole).alias("good"),
            (held["bad"] + r["bad"]).cast(whole).alias("bad"),
            (held["twice"] + r["twice"] + across).cast(whole).alias("twice"),
        )

    pairs = F.col("t.good").cast("double") * F.col("t.bad").cast("double")
    return totals.select(F.aggregate("ranges", start, passed).alias("t")).select(
        F.col("t.good").cast("long").alias("n_good"),
        F.col("t.bad").cast("long").alias("n_bad"),
        F.when(pairs > 0, F.round(F.col("t.twice").cast("double") / 2 / pairs, 9)).alias("auc"),
    )


def draw(key: str, label: str, seed: int) -> Column:
    """A 64-bit draw of each row from its label and key."""
    return F.xxhash64(F.lit(seed), F.col(label), F.col(key))


def split_points(
    df: DataFrame, key: str, label: str, share: Fraction | float, seed: int
) -> dict[object, tuple[int, int] | None]:
    """Per label the largest leading bits of a draw that still belong to the share: (bits shifted away, value).

    An order statistic found by counting. The first pass counts the rows of each label by the leading bits of their
    draws; where the wanted number ends inside a bucket, the next pass counts that bucket alone by further bits. Every
    pass returns at most 4,096 counts a label, no row is moved or sorted, and a bucket holds 1 / 4,096 of the one before.
    None stands for a label of which no row belongs to the share. Rows of one draw, as those that repeat a key, cannot be
    told apart and stay outside together if the share ends among them.
    """
    part = Fraction(share).limit_denominator(10**6)
    value, open_, shift, found = draw(key, label, seed), {}, 64, {}
    while True:
        last, shift = shift, max(0, shift - DIGIT)
        inside = F.lit(True)
        if open_:
            at = F
            for name, (_, prefix) in open_.items():
                at = at.when(F.col(label) == name, F.shiftright(value, last) == F.lit(prefix))
            inside = at.otherwise(False)
        counted = (
            df.where(F.col(label).isNotNull() & inside)
            .groupBy(F.col(label).alias("label"), F.shiftright(value, shift).alias("bits"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        buckets: dict[object, list[tuple[int, int]]] = {}
        for row in sorted(counted, key=lambda r: r["bits"]):
            buckets.setdefault(row["label"], []).append((row["bits"], row["n"]))
        if last == 64:
            wanted = {name: math.floor(sum(n for _, n in b) * part) for name, b in buckets.items()}
        else:
            wanted = {name: need for name, (need, _) in open_.items()}
        open_ = {}
        for name, need in wanted.items():
            found.setdefault(name, None)
            for bits, n in buckets[name]:
                if need < n:
                    # what lies before this bucket is in, and part of the bucket if the share is not full yet
                    if need and shift:
                        open_[name] = (need, bits)
                    break
                need -= n
                found[name] = (shift, bits)
        if not open_:
            return found


def in_share(df: DataFrame, key: str, label: str, share: Fraction | float = Fraction(4, 5), seed: int = 42) -> Column:
    """Whether a row is among floor(share * rows) rows of its label, chosen by draws; exact for unique keys.

    The points are found by jobs that run now; the condition itself reads one row at a time. Rows without a label are
    in no share.
    """
    value, chosen = draw(key, label, seed), F
    for name, point in split_points(df, key, label, share, seed).items():
        inside = F.lit(False) if point is None else F.shiftright(value, point[0]) <= F.lit(point[1])
        chosen = chosen.when(F.col(label) == name, inside)
    return F.lit(False) if chosen is F else chosen.otherwise(False)
