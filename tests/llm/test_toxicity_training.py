"""Toxicity: every labelled row teaches, in shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from feedwatch.llm import toxicity

N = 9000


def test_training_counts_every_labelled_row(spark, monkeypatch):
    made = []
    monkeypatch.setattr(toxicity, "ROUNDS", 1)
    monkeypatch.setattr(toxicity, "network_of", lambda counts, share, seed=11, of=toxicity.network_of: made.append(counts.sum()) or of(counts, share, seed))
    docs = spark.range(N).select(F.col("id").alias("doc_id"), F.concat(F.lit("only"), "id", F.when(F.col("id") % 3 == 0, " vile").otherwise(" kind")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    net = toxicity.train(docs, labels, "doc_id", "toxic")
    assert made[0] > 0.7 * N * 2  # two thousand rows of either label were read before
    scored = toxicity.score(docs, net).join(labels, "doc_id")
    assert scored.where((F.col("score") >= toxicity.THRESHOLD) != (F.col("toxic") == 1)).count() < N / 100


def test_the_driver_gets_one_network_a_round(spark, monkeypatch):
    """Eight shards of 4 MB each, and no more than 6 MB for the results of a job."""
    monkeypatch.setattr(toxicity, "ROUNDS", 2)
    monkeypatch.setattr(toxicity, "SHARD", 100)
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("only"), "id", F.when(F.col("id") % 3 == 0, " vile").otherwise(" kind")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    conf = spark.sparkContext._jsc.sc().conf()
    held = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "6m")
    try:
        net = toxicity.train(docs, labels, "doc_id", "toxic")
    finally:
        conf.set("spark.driver.maxResultSize", held)
    scored = toxicity.score(docs, net).join(labels, "doc_id")
    assert scored.where((F.col("score") >= toxicity.THRESHOLD) != (F.col("toxic") == 1)).count() == 0


def test_pieces_of_a_network_make_it_again():
    net = toxicity.network_of(np.zeros((2, 1 << toxicity.BITS)), 0.0, seed=1)
    sums = toxicity.first_sums(net)
    sums["i"] = 3.0
    other = toxicity.network_of(np.zeros((2, 1 << toxicity.BITS)), 0.0, seed=2)
    others = toxicity.first_sums(other, 1.0)
    pieces = dict(toxicity.parts(net, sums))
    assert max(len(x) for x in pieces.values()) <= toxicity.PIECE
    toxicity.put_together(other, others, pieces)
    for a, b in zip(toxicity._arrays(net, sums), toxicity._arrays(other, others), strict=True):
        assert (a == b).all()
    assert (other.intercept, others["i"]) == (-1.0, 3.0)
