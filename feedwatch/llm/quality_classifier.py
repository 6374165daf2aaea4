"""Quality classifier: naive Bayes support vectors.

A text's features are the indicators of its hashed word and word-pair n-grams. Words are
runs of letters and digits, and runs of other signs count as words too, so that signs
glued to words are seen. Each indicator is scaled by its class log-count ratio, and a
linear hinge-loss model is fitted on the scaled indicators by dual coordinate descent.
Margins become probabilities through a logistic curve over rows kept out of the fit.

The model is fitted on at most ``sample`` labelled rows (about, chosen by a hash of the
id), as sets of features made by Spark tasks; the size of the model doesn't depend on
the data. Scoring reads every whole text once and shuffles nothing.

Nulls and empty texts have no features and get the score of the intercept. A very long text is read
whole by one task and has at most 2^BITS features. Rows without
a label, or with a label other than 0 and 1, aren't learnt from. With labels of one class
only, or none, the score is that class's share (one half without any). Repeated rows are
scored one by one; several labels of an id count as several rows. Extra columns aren't read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TokenHasher, bounded_sample, fold, map_texts, platt, sigmoid, table

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
BITS = 18
#: Labelled rows that a model is fitted on at most; more rows hardly change a linear model of this size.
SAMPLE = 6000
FOLDS = 5
THRESHOLD = 0.3


def features(text: str | None, hashes: TokenHasher) -> np.ndarray:
    """The distinct hashed n-grams of a whole text, as sorted indices below 2^BITS."""
    ids = hashes.array(TOKEN.findall(text)) if text else np.zeros(0, np.uint64)
    pairs = (ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)
    seen = np.zeros(1 << BITS, bool) if len(ids) > 20_000 else None
    both = np.concatenate([ids & np.uint64((1 << BITS) - 1), pairs]).astype(np.int32)
    if seen is None:
        return np.unique(both)
    seen[both] = True
    return np.flatnonzero(seen).astype(np.int32)


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, label: str, limit: int, text: str = "text") -> DataFrame:
    """Texts and __label of documents with a label of 0 or 1, about ``limit`` at most; the few labels are broadcast."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label"))
    chosen = F.broadcast(bounded_sample(known, "__id", limit))
    read_docs = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text"))
    return read_docs.join(chosen, F.col("__doc") == F.col("__id")).select(F.col("__text").alias(text), "__label")


@dataclass
class Model:
    """Margin = weight of each feature present, summed, plus intercept; then a logistic curve."""

    weight: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        margins = np.array([self.weight[r].sum() / max(1.0, np.sqrt(len(r))) for r in rows]) + self.intercept
        return sigmoid(self.slope * margins + self.shift)


def log_count_ratio(rows: list[np.ndarray], label: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = np.full((2, 1 << BITS), alpha)
    for r, y in zip(rows, label, strict=True):
        counts[y, r] += 1
    p = counts / np.abs(counts).sum(axis=1, keepdims=True)
    return np.log(p[1] / p[0])


def dual_coordinate_descent(
    rows: list[np.ndarray], ratio: np.ndarray, label: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7
) -> tuple[np.ndarray, float]:
    """Linear hinge-loss weights on rows of ratio-scaled indicators of unit-root length.

    One dual variable a row, kept in [0, C] with C weighted by class so that a rare class
    counts as much as a common one; the intercept is a feature that is always 1.
    """
    sign = np.where(label > 0, 1.0, -1.0)
    share = np.array([len(label) / (2 * max(1, (label == y).sum())) for y in (0, 1)])
    upper = c * np.minimum(share, 10)[label]
    scale = np.array([1 / max(1.0, np.sqrt(len(r))) for r in rows])
    norm = np.array([(ratio[r] ** 2).sum() * s * s + 1 for r, s in zip(rows, scale, strict=True)])
    w, b, alpha = np.zeros_like(ratio), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            r = rows[i]
            x = ratio[r] * scale[i]
            gradient = sign[i] * (w[r] @ x + b) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), upper[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[r] += step * x
                b += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w * ratio, b


def fit(rows: list[np.ndarray], label: np.ndarray) -> Model:
    ones = int(label.sum())
    if ones in (0, len(label)):
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, float(np.log((ones + 1) / (len(label) - ones + 1))))
    order = np.random.default_rng(3).permutation(len(label))
    kept_out = np.zeros(len(label), bool)
    kept_out[order[: len(order) // 4]] = True
    if len(set(label[kept_out])) < 2 or len(set(label[~kept_out])) < 2:
        kept_out[:] = True
        learnt = np.arange(len(label))
    else:
        learnt = np.flatnonzero(~kept_out)
    chosen = [rows[i] for i in learnt]
    ratio = log_count_ratio(chosen, label[learnt])
    weight, intercept = dual_coordinate_descent(chosen, ratio, label[learnt])
    model = Model(weight, intercept)
    out = np.flatnonzero(kept_out)
    margin = np.array([weight[rows[i]].sum() / max(1.0, np.sqrt(len(rows[i]))) for i in out]) + intercept
    model.slope, model.shift = platt(margin, label[out])
    model.weight = weight.astype(np.float32)
    return model


def train(learnt: DataFrame, text: str = "text", label: str = "__label") -> Model:
    """Fits the model on all rows given; ``labelled`` bounds them."""

    def start():
        hashes = TokenHasher()
        return lambda texts: [[features(t, hashes).tobytes() for t in texts]]

    made = map_texts(learnt.select(F.col(label).alias("__y"), text), T.StructType([T.StructField("__x", T.BinaryType())]), start, text)
    found = sorted((bytes(r["__x"]), r["__y"]) for r in made.collect())
    return fit([np.frombuffer(x, np.int32) for x, _ in found], np.array([y for _, y in found], dtype=int))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score instead of the text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.intercept, model.slope, model.shift))

    def start():
        hashes, m = TokenHasher(), Model(*shared.value)
        return lambda texts: [m.score([features(t, hashes) for t in texts])]

    return map_texts(docs, T.StructType([T.StructField("score", T.DoubleType())]), start, text)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", FOLDS) != 0)
    model = train(labelled(docs, labels, "doc_id", "quality", SAMPLE))
    scored = score(docs.withColumn("held_out", fold("doc_id", FOLDS) == 0), model)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op5_quality_classifier": (op5_quality_classifier, None)}
