"""Hinge-loss training over tables reaches the objective that the vector optimiser reaches."""

import numpy as np
import pytest
from conftest import SF
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from feedwatch.operators import hinge, linear
from feedwatch.sources import derived

RIDGE = 0.02
LABELS = "site string, post_id string, y double, c double"
FEATURES = "site string, post_id string, block string, term string, weight double"


def objective(x, y, c, w, b):
    return RIDGE / 2 * w @ w + (c * np.maximum(0, 1 - y * (x @ w + b))).sum() / c.sum()


def made(n=120, terms=40, seed=3):
    """Posts with a few of many terms, of unequal numbers of either label, some with no term at all."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, terms)) < 0.1, rng.random((n, terms)), 0.0)
    x[:5] = 0
    y = np.where(x[:, :6].sum(axis=1) + 0.3 * rng.normal(size=n) > 0.35, 1.0, -1.0)
    c = np.where(y > 0, n / (2 * (y > 0).sum()), n / (2 * (y < 0).sum()))
    return x, y, c


def tables(spark, x, y, c):
    labels = spark.createDataFrame([("s", str(i), float(y[i]), float(c[i])) for i in range(len(y))], LABELS)
    rows = [("s", str(i), "title" if t % 2 else "tags", f"t{t}", float(x[i, t])) for i, t in zip(*np.nonzero(x))]
    return spark.createDataFrame(rows, FEATURES), labels


def weights(fitted, terms):
    w = np.zeros(terms)
    for r in fitted.terms.collect():
        w[int(r["term"][1:])] = r["weight"]
    return w


def test_objective_equals_the_vector_optimiser(spark):
    x, y, c = made(60, 12)
    fitted = hinge.fit_hinge(*tables(spark, x, y, c), RIDGE)
    got = objective(x, y, c, weights(fitted, x.shape[1]), fitted.intercept)
    assert got == pytest.approx(fitted.objective, rel=1e-9) and fitted.bound <= got <= fitted.bound * (1 + 2 * hinge.TOLERANCE)
    rows = [(Vectors.dense(v), float(s > 0), float(k)) for v, s, k in zip(x, y, c)]
    svc = LinearSVC(weightCol="weight", regParam=RIDGE, standardization=False, maxIter=100, tol=1e-7)
    other = svc.fit(spark.createDataFrame(rows, ["features", "label", "weight"]).coalesce(1))
    want = objective(x, y, c, other.coefficients.toArray(), other.intercept)
    assert got <= want * (1 + 1e-4) and fitted.bound <= want


def test_hot_terms_take_the_same_way(spark, hot_keys):
    x, y, c = made(40, 8)
    fitted = hinge.fit_hinge(*tables(spark, x, y, c), RIDGE, 5e-2)
    got = objective(x, y, c, weights(fitted, 8), fitted.intercept)
    assert got == pytest.approx(fitted.objective, rel=1e-9) and got <= fitted.bound * 1.06
    assert {r["term"]: r["df"] for r in fitted.terms.collect()} == {f"t{t}": (x[:, t] > 0).sum() for t in range(8) if x[:, t].any()}


def test_lowest_point_is_the_minimum_of_the_planes():
    """Against a fine search over one weight and the intercept."""
    rng = np.random.default_rng(0)
    g, slope, height = rng.normal(size=6), np.array([1, -1, 0.5, -0.5, 0.2, -0.7]), rng.random(6)
    shares, b, bound = hinge.lowest_point(np.outer(g, g), slope, height, 0.5)
    w = -shares @ g / 0.5
    grid_w, grid_b = np.meshgrid(np.linspace(w - 1, w + 1, 801), np.linspace(b - 1, b + 1, 801))
    values = 0.25 * grid_w**2 + np.max([gk * grid_w + sk * grid_b + hk for gk, sk, hk in zip(g, slope, height)], axis=0)
    assert values.min() == pytest.approx(bound, abs=5e-3) and values.min() >= bound - 1e-9
    assert shares.min() >= 0 and shares.sum() == pytest.approx(1) and abs(shares @ slope) < 1e-8


def test_model_of_posts_scores_what_it_learnt(spark):
    posts = derived.posts(spark, SF)
    model = linear.hinge_model(posts, tolerance=0.2)
    scored = model.score(posts.where(F.col("notify").isNotNull())).select("notify", "score").collect()
    liked, other = ([r["score"] for r in scored if r["notify"] == k] for k in (True, False))
    ranked = np.mean([a > b for a in liked for b in other])
    assert ranked > 0.75 and all(0 <= r["score"] <= 1 for r in scored)
    assert model.terms.where("idf IS NULL OR weight IS NULL").count() == 0
    assert linear.hinge_model(posts.where("notify IS NULL OR notify")).reason == "single_class"
