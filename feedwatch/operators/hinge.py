"""Linear hinge-loss training whose weights and features stay tables: optimised cutting planes.

The objective is that of the vector model, lambda/2 |w|^2 + mean weighted hinge with a free intercept.
Any set S of posts gives a plane below the mean hinge: the sum over S of c (1 - y f) / W. Each
round joins the posts of one such set to their features, adds them up by term, and joins that sum back
to the features, so a plane is known by what it gives for each post. The minimum of the best lower
bound that all planes make is a small quadratic programme over planes; its value and the best
objective seen enclose the optimum, which tells when to stop.

The driver holds one row of numbers for each plane and nothing by term or post. A post's row holds a
number and a flag for each plane. Weights by term are made once, in the end, from the posts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..conf import shared_dir
from ..sources.schemas import POST_KEYS
from .model import remove_folder
from .skew import lookup_join

TOLERANCE = 1e-4
MOST_PLANES = 300
#: Places between the best point and the newest one at which the objective is tried.
STEPS = tuple(i / 16 for i in range(17))
#: How far beyond the best point, towards the newest one, the next plane is laid.
AHEAD = 0.1


@dataclass(frozen=True)
class HingeFit:
    """``terms`` (block, term, df, weight), the intercept, and what is known of the optimum."""

    terms: DataFrame
    intercept: float
    objective: float
    bound: float
    planes: int


def lowest_point(gram: np.ndarray, slope: np.ndarray, height: np.ndarray, ridge: float, steps: int = 100) -> tuple[np.ndarray, float, float]:
    """Shares of the planes at the minimum of ridge/2 |w|^2 + max of planes, the intercept there, and a lower bound.

    Interior-point steps on the dual: shares at least 0 that sum to 1 and whose slopes cancel.
    """
    n = len(height)
    q = gram / ridge
    a = np.vstack([np.ones(n), slope])
    x, s, y = np.full(n, 1 / n), np.ones(n), np.zeros(2)
    for _ in range(steps):
        off = q @ x - height - a.T @ y - s
        miss = a @ x - np.array([1.0, 0.0])
        gap = x @ s / n
        if gap < 1e-12 and np.abs(off).max() < 1e-10 and np.abs(miss).max() < 1e-10:
            break
        system = np.block([[q + np.diag(s / x), -a.T], [a, np.zeros((2, 2))]])
        pull = 0.1 * gap / x - s
        step = np.linalg.lstsq(system, np.concatenate([-off + pull, -miss]), rcond=None)[0]
        dx, dy = step[:n], step[n:]
        ds = pull - s / x * dx
        reach = min([1.0] + [0.99 * float((-v[d < 0] / d[d < 0]).min()) for v, d in ((x, dx), (s, ds)) if (d < 0).any()])
        x, s, y = x + reach * dx, s + reach * ds, y + reach * dy
    return x, float(y[1]), float(height @ x - x @ q @ x / 2)


def _sum_of(values: Column, factors: np.ndarray) -> Column:
    products = F.zip_with(values, F.array(*[F.lit(float(f)) for f in factors]), lambda v, f: v * f)
    return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)


def fit_hinge(features: DataFrame, labels: DataFrame, ridge: float, tolerance: float = TOLERANCE, most_planes: int = MOST_PLANES) -> HingeFit:
    """Fits ``labels`` (POST_KEYS, y of 1 or -1, c) by ``features`` (POST_KEYS, block, term, weight).

    The objective is within ``tolerance``, as a share, of the optimum, unless ``most_planes`` planes
    don't suffice; ``bound`` tells. Posts without a feature count by their intercept. Both labels must occur.
    """
    spark, folders = features.sparkSession, []

    def stored(df: DataFrame, name: str) -> DataFrame:
        folders.append(shared_dir(spark, name))
        df.write.parquet(folders[-1])
        return spark.read.schema(df.schema).parquet(folders[-1])

    x = stored(features.select(*POST_KEYS, "block", "term", F.col("weight").alias("value")), "features")
    start = labels.select(*POST_KEYS, F.col("y").cast("double").alias("y"), F.col("c").cast("double").alias("c"))
    state = stored(start.withColumns({"on": F.array().cast("array<boolean>"), "m": F.array().cast("array<double>")}), "posts")
    total = state.agg(F.sum("c")).first()[0]
    gram, slope, height = np.zeros((0, 0)), np.zeros(0), np.zeros(0)

    def by_term(factor: Column) -> DataFrame:
        return x.join(state.select(*POST_KEYS, factor.alias("by")), POST_KEYS).groupBy("block", "term").agg(F.sum(F.col("value") * F.col("by")).alias("g"), F.count(F.lit(1)).alias("df"))

    def add_plane(on: Column) -> None:
        nonlocal state, gram, slope, height
        pull = -F.col("c") * F.col("y") / total
        plane = by_term(F.when(on, pull).otherwise(0.0))
        given = lookup_join(x, plane, ["block", "term"], spread_by=POST_KEYS, rows_col="df")
        given = given.groupBy(*POST_KEYS).agg(F.sum(F.col("value") * F.col("g")).alias("given"))
        joined = state.join(given, POST_KEYS, "left")
        grown = joined.select(*POST_KEYS, "y", "c", F.array_append("on", on).alias("on"), F.array_append("m", F.coalesce("given", F.lit(0.0))).alias("m"))
        state = stored(grown, "posts")
        n = len(height) + 1
        laid = F.when(F.element_at("on", -1), pull).otherwise(0.0)
        sums = state.agg(F.sum(laid), F.sum(F.when(F.element_at("on", -1), F.col("c")).otherwise(0.0)) / total, *[F.sum(laid * F.col("m")[k]) for k in range(n)]).first()
        wider = np.zeros((n, n))
        wider[:-1, :-1] = gram
        wider[-1], wider[:, -1] = sums[2:], sums[2:]
        gram, slope, height = wider, np.append(slope, sums[0]), np.append(height, sums[1])

    for y in (1.0, -1.0):
        add_plane(F.col("y") == y)
    best, best_b, best_value, bound = np.zeros(2), 0.0, np.inf, -np.inf
    while True:
        shares, b, below = lowest_point(gram, slope, height, ridge)
        bound = max(bound, below)
        newest = -shares / ridge
        best = np.append(best, np.zeros(len(newest) - len(best)))
        at, to = _sum_of(F.col("m"), best) + best_b, _sum_of(F.col("m"), newest) + b
        margins = state.select("y", "c", at.alias("at"), to.alias("to"))
        loss = lambda t: F.sum(F.col("c") * F.greatest(F.lit(0.0), 1 - F.col("y") * (F.col("at") + t * (F.col("to") - F.col("at"))))) / total
        losses = margins.agg(*[loss(t) for t in STEPS]).first()
        points = [best + t * (newest - best) for t in STEPS]
        values = [ridge / 2 * p @ gram @ p + v for p, v in zip(points, losses, strict=True)]
        least = int(np.argmin(values))
        if values[least] < best_value:
            t = STEPS[least]
            best, best_b, best_value = points[least], best_b + t * (b - best_b), values[least]
        if best_value - bound <= tolerance * best_value or len(height) >= most_planes:
            break
        ahead, ahead_b = best + AHEAD * (newest - best), best_b + AHEAD * (b - best_b)
        add_plane(F.col("y") * (_sum_of(F.col("m"), ahead) + ahead_b) < 1)
    held = F.zip_with("on", F.array(*[F.lit(float(f)) for f in best]), lambda on, f: F.when(on, f).otherwise(0.0))
    dual = F.aggregate(held, F.lit(0.0), lambda s, v: s + v)
    weights = by_term(-F.col("c") * F.col("y") / total * dual).select("block", "term", "df", F.col("g").alias("weight"))
    path = shared_dir(spark, "weights")
    weights.write.parquet(path)
    for folder in folders:
        remove_folder(spark, folder)
    return HingeFit(spark.read.schema(weights.schema).parquet(path), float(best_b), float(best_value), float(bound), len(height))
