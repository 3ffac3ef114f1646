"""Penalised logistic regression by Newton steps over all rows, each step one aggregate of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.operators.scoring import FEATURES, Scorecard, Weight, log_odds
from ledgerlane.session import ensure_checkpoint_dir

#: Newton steps before the fit gives up; a few are enough from where the sample ends.
MOST_STEPS = 100
#: Rows from which the starting point is fitted. They decide how many steps follow, not where these end.
SAMPLED = 4096


def _local_sums(values: np.ndarray, mean: np.ndarray, std: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature of some rows (features, then the label) at ``beta``, in one vector."""
    design = np.column_stack([np.ones(len(values)), (values[:, :-1] - mean) / std])
    y, odds = values[:, -1], design @ beta
    p = np.exp(-np.logaddexp(0.0, -odds))
    curvature = (design * (p * (1.0 - p))[:, None]).T @ design
    return np.concatenate([[np.sum(np.logaddexp(0.0, odds) - y * odds)], design.T @ (p - y), curvature.ravel()])


def _sums(rows: DataFrame, mean: np.ndarray, std: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """The same sums over all rows.

    Every task reduces its rows to one vector of 1 + k + k * k numbers; those are summed per place in the cluster, so
    the driver gets one vector however many tasks there are.
    """
    local = _local_sums

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(beta)
        total = np.zeros(1 + k + k * k)
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            total += local(values.astype(float), mean, std, beta)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["total"])

    places = rows.mapInArrow(partial, "total array<double>").select(F.posexplode("total").alias("place", "value"))
    held = dict(places.groupBy("place").agg(F.sum("value")).collect())
    return np.array([held[i] for i in range(len(held))])


def _minimum(sums: Callable[[np.ndarray], np.ndarray], penalty: np.ndarray, start: np.ndarray, near: float) -> np.ndarray:
    """The point where the penalised gradient is at most ``near``, by Newton steps with halving."""
    k = len(start)

    def at(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        whole = sums(point)
        curvature = whole[1 + k :].reshape(k, k) + np.diag(penalty)
        return whole[0] + penalty @ point**2 / 2, whole[1 : 1 + k] + penalty * point, curvature

    beta, (loss, gradient, curvature) = start, at(start)
    for _ in range(MOST_STEPS):
        if np.max(np.abs(gradient)) <= near:
            return beta
        step = np.linalg.solve(curvature, gradient)
        tried = at(beta - step)
        # the loss is convex: where a full step overshoots, a shorter one does not
        while tried[0] > loss * (1 + 1e-12) and np.max(np.abs(step)) > 1e-12:
            step = step / 2
            tried = at(beta - step)
        beta, (loss, gradient, curvature) = beta - step, tried
    raise RuntimeError(f"the fit did not settle in {MOST_STEPS} steps")


def fit(rows: DataFrame, label: str, features: list[str] = FEATURES, strength: float = 1.0) -> Scorecard:
    """Coefficients of the standardised features that minimise loss + strength / 2 * |weights|^2 over all rows.

    Features are scaled by their mean and population deviation (a constant one counts as 0), the intercept is not
    penalised. The steps start where a fit of at most `SAMPLED` rows ends, those first by a hash of their values, and
    go on over all rows until the gradient of all rows vanishes; the minimum is unique. ``rows`` are kept in the
    checkpoint folder while the steps run; beside the sample nothing but sums of fixed size reaches the driver. Rows
    with a null feature or label are left out. Raises ValueError unless both labels occur.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    columns = [F.col(c).cast("double").alias(c) for c in (*features, label)]
    # fixed first: a filter on computed columns would be pushed below them and compute them again
    fixed = rows.select(*columns).checkpoint().dropna()
    stats = fixed.agg(
        F.count(F.lit(1)), F.sum(label), *[F.avg(c) for c in features], *[F.stddev_pop(c) for c in features]
    ).first()
    n, positive = stats[0], stats[1]
    if not 0 < (positive or 0) < n:
        raise ValueError(f"a fit needs rows of both labels, got {n} rows with {positive or 0:.0f} positive")
    mean, std = (np.array(stats[2 + i * len(features) :][: len(features)], dtype=float) for i in (0, 1))
    std = np.where(std > 0, std, 1.0)
    penalty, start = np.array([0.0] + [strength] * len(features)), np.zeros(len(features) + 1)
    sample = np.array(fixed.orderBy(F.xxhash64(*fixed.columns)).limit(SAMPLED).collect(), dtype=float)
    if 0 < sample[:, -1].sum() < len(sample):
        share = len(sample) / n
        start = _minimum(lambda b: _local_sums(sample, mean, std, b), penalty * share, start, 1e-6 * len(sample))
    beta = _minimum(lambda b: _sums(fixed, mean, std, b), penalty, start, 1e-9 + 1e-12 * n)
    return Scorecard(
        float(beta[0]),
        tuple(Weight(f, float(b), float(m), float(s)) for f, b, m, s in zip(features, beta[1:], mean, std)),
    )


def gradient(rows: DataFrame, label: str, card: Scorecard, strength: float = 1.0) -> DataFrame:
    """The penalised gradient per feature at a card's coefficients, over all rows: zero where the card is the minimum.

    Plain sums of columns, independent of how the card was fitted.
    """

    def derivative(z: Column, weight: float) -> Column:
        return F.sum((F.col("p") - F.col(label)) * z) + F.lit(strength * weight)

    scored = rows.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds(card))))
    names = ["intercept", *[w.feature for w in card.weights]]
    row = scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        derivative(F.lit(1.0), 0.0).alias("intercept"),
        *[derivative((F.col(w.feature) - F.lit(w.mean)) / F.lit(w.std), w.coefficient).alias(w.feature) for w in card.weights],
    )
    return row.unpivot(["n_rows"], names, "feature", "gradient").select("feature", "n_rows", "gradient")


def card_rows(card: Scorecard) -> list[tuple[str, float, float, float]]:
    return [("intercept", card.intercept, 0.0, 1.0), *[(w.feature, w.coefficient, w.mean, w.std) for w in card.weights]]


CARD_SCHEMA = "feature string, coefficient double, mean double, std double"


def card_of(rows: list) -> Scorecard:
    """A card from its stored rows, in any order."""
    held = {r["feature"]: r for r in rows}
    order = [f for f in FEATURES if f in held] + sorted(set(held) - set(FEATURES) - {"intercept"})
    weights = tuple(Weight(f, held[f]["coefficient"], held[f]["mean"], held[f]["std"]) for f in order)
    return Scorecard(held["intercept"]["coefficient"], weights)

