"""Clustering with bounds against plain rounds over Python integers."""

import hashlib
import math
import random

import brute
import numpy as np
import pytest
from conftest import SF

from feedwatch.llm import centroids, registry
from feedwatch.llm.common import table


def nearest(x, cs):
    return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(cs))


def plain(rows, k=40, rounds=5, dimension=64):
    """Result rows of (vec_id, embedding), by plain rounds."""
    usable = [(i, e) for i, e in rows if e is not None and len(e) == dimension and all(v is not None and math.isfinite(v) for v in e)]
    ints = [(i, [math.floor(256 * v) for v in e]) for i, e in usable]
    place = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cs = [x for _, x in sorted(ints, key=place)[:k]]
    for _ in range(rounds):
        held = [[] for _ in cs]
        for _, x in ints:
            held[nearest(x, cs)[1]].append(x)
        cs = [[sum(v) // len(h) for v in zip(*h, strict=True)] if h else c for h, c in zip(held, cs, strict=True)]
    found = [(i, *nearest(x, cs)) for i, x in ints]
    own = {c: sum(d for _, d, at in found if at == c) for c in range(len(cs))}
    return [(i, c, d, own[c], sum(own.values()), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, d, c in found]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, ids string, distance int")


def test_query_equals_plain_rounds(spark):
    out = registry.queries()["op13_centroids"](spark, SF)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = plain([tuple(r) for r in table(spark, SF, "embeddings").select("vec_id", "embedding").collect()])
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_ties_and_small_values_equal_plain_rounds(spark):
    rng = random.Random(3)
    for k, spread in ((4, 2), (7, 1), (60, 2)):
        rows = [(i, [rng.randrange(-spread, spread + 1) / 256 for _ in range(3)], "x", "y", 0) for i in range(50)]
        out = centroids.clusters(centroids.kept(vectors(spark, rows), dimension=3), k=k, dimension=3, block_rows=7)
        assert sorted(map(tuple, out.collect())) == sorted(plain([r[:2] for r in rows], k, dimension=3))


def test_bounds_hold_and_spare_most_distances(spark):
    rng = np.random.default_rng(4)
    x = np.floor(np.concatenate([rng.normal(c, 30, (300, 8)) for c in rng.uniform(-2000, 2000, (12, 8))]))
    start = x[rng.choice(len(x), 12, replace=False)]
    history, state, scanned = [start.astype(np.int64)], None, []
    for _ in range(8):
        known = centroids.History(history)
        state = centroids.reassign(x, state, known)
        exact = centroids.squared(x, known.now)
        assert (state["cluster"] == exact.argmin(1)).all()
        rows = np.arange(len(x))
        upper = np.sqrt(state["own"]) + known.moved[state["own_round"], state["cluster"]]
        lower = np.sqrt(state["other"]) - known.others[state["other_round"], state["cluster"]]
        own = np.sqrt(exact[rows, state["cluster"]])
        exact[rows, state["cluster"]] = np.inf
        assert (own <= upper + 1e-6).all() and (np.sqrt(exact.min(1)) >= lower - 1e-6).all()
        scanned.append(state["rescanned"])
        sums = np.array([x[state["cluster"] == c].sum(0) for c in range(12)]).astype(np.int64).astype(object)
        history.append(centroids.recentred(history[-1], sums, np.bincount(state["cluster"], minlength=12).astype(object)))
    assert scanned[0] == len(x) and sum(scanned) < 8 * len(x) // 3 and scanned[-1] < len(x) // 10


def test_total_displacement_is_shorter_than_the_steps():
    there, back = np.array([[0, 0], [9, 9]]), np.array([[5, 0], [9, 9]])
    known = centroids.History([there, back, there])
    assert known.moved[0].tolist() == [0, 0] and known.moved[1].tolist() == [5, 0]
    assert known.others[1].tolist() == [0, 5]


@pytest.mark.parametrize("block_rows", [3, 4096])
def test_awkward_rows(spark, block_rows):
    good = [[float(k), 0.5, -2.0] for k in range(5)]
    bad = [None, [], [1.0], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [0.0, 0.0, float("-inf")], [0.0] * 4]
    rows = [(i, e, "x", "y", 0) for i, e in enumerate(good + bad)]
    rows += [(None, good[0], None, None, None)] * 2 + [(1, good[1], None, None, None)] * 3
    df = vectors(spark, rows)
    out = centroids.clusters(centroids.kept(df, dimension=3), k=6, dimension=3, block_rows=block_rows).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, plain([r[:2] for r in rows], 6, dimension=3)))
    assert centroids.clusters(centroids.kept(df.limit(0))).count() == 0
    far = spark.createDataFrame([(i, [1e30 * (i - 1)] * 3) for i in range(3)], "vec_id long, embedding array<float>")
    out = centroids.clusters(centroids.kept(far, dimension=3), k=3, dimension=3).collect()
    assert len({r["cluster"] for r in out}) == 3 and all(r["distance"] == 0 for r in out)
    assert centroids.kept(brute.empty_docs(spark).selectExpr("doc_id AS vec_id", "array(score) AS embedding")).count() == 0
