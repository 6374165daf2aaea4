"""Toxicity: a convolutional text classifier trained in numpy.

A token's embedding is the sum of the embeddings of its hashed word and of its hashed
first four and first five characters, so that inflected forms share what they have in
common. Filters one, two and three tokens wide run over a whole text, the largest
response of each is kept (max pooling), and a linear layer gives the logit. Thresholds
are calibrated by language: the language is guessed from function words of the text
itself, never from a column, and each language's threshold becomes the same score.

It is fitted on all labelled rows. They are dealt into shards of about ``SHARD`` rows by a hash of id and
tokens; in each round every shard learns from the same network, and the networks (and the sums that set
their rates) are averaged. A quarter of the rows, by a hash too, is kept for curve and thresholds, from
counts of their logits in steps of 1 / ``GRID``. The model's size is fixed, and what comes to the driver is
the network and those counts. Scoring reads each whole text once and shuffles
nothing; long texts go through in slices that overlap by the widest filter.

Nulls, empty texts and texts without a letter or digit have one empty token. Labels other
than 0 and 1 aren't learnt from; with labels of one class only, or none, every score is
that class's share (0 without any). Repeated rows are scored one by one. Extra columns
aren't read.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, map_texts, mix, platt, sigmoid, stored, table

TOKEN = re.compile(r"[^\W_]+")
BITS = 16
SIZE = 8  # of an embedding
WIDTHS = (1, 2, 3)
FILTERS = 8  # of each width
#: Labelled rows that learn in one task, about; the whole table learns in as many as it takes.
SHARD = 8000
ROUNDS = 5
#: Numbers of a network in one record, and tasks that add the records of all shards, at most.
PIECE, ADDING = 8192, 64
#: Steps of the logits that calibration tells apart, per unit; larger logits than LIMIT count as LIMIT.
GRID, LIMIT = 500, 60
FOLDS = 4
HELD_OUT = 2
THRESHOLD = 0.3
SLICE = 20_000

# Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for with as on this was by are be at from",
    "de": "der die das und ist von den mit zu im nicht ein eine auf dem des sich für auch",
    "fr": "le les des et est un une du dans que pour qui sur pas par avec au ce sont",
    "es": "el los las y es que en un una del se por con para su al lo como más",
}
LANGUAGES = (*FUNCTION_WORDS, "other")
_LANGUAGE_OF: dict[str, int] = {}
for _at, _words in enumerate(FUNCTION_WORDS.values()):
    for _word in _words.split():
        _LANGUAGE_OF[_word] = -1 if _word in _LANGUAGE_OF else _at


class Tokens(dict):
    """Token to its three buckets, packed, and its language; remembered up to a limit."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        packed = 0
        for part in (token + "$", "^" + token[:4], "^" + token[:5]):
            packed = packed << BITS | mix(zlib.crc32(part.encode("utf-8", "surrogatepass"))) & ((1 << BITS) - 1)
        self[token] = packed = packed << 3 | _LANGUAGE_OF.get(token, -1) + 1
        return packed

    def read(self, text: str | None) -> tuple[np.ndarray, int]:
        """(tokens, 3) buckets of a whole text, and the index of its language."""
        found = TOKEN.findall(text.lower()) if text else []
        packed = np.fromiter(map(self.__getitem__, found or [""]), np.uint64, len(found) or 1)
        votes = np.bincount((packed & np.uint64(7)).astype(np.intp), minlength=len(LANGUAGES))[1:]
        language = int(votes.argmax()) if votes.any() else len(LANGUAGES) - 1
        last = np.uint64((1 << BITS) - 1)
        return np.stack([(packed >> np.uint64(3 + BITS * k) & last) for k in (2, 1, 0)], axis=1).astype(np.int32), language


@dataclass
class Network:
    embedding: np.ndarray
    filters: list[np.ndarray]  # by width: (width, SIZE, FILTERS)
    bias: np.ndarray
    output: np.ndarray
    intercept: float
    slope: float = 1.0
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest responses, where they are, and the token embeddings of a slice."""
        e = self.embedding[ids].sum(axis=1)
        if len(e) < max(WIDTHS):
            e = np.concatenate([e, np.zeros((max(WIDTHS) - len(e), SIZE), e.dtype)])
        best, where = [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            n = len(e) - w + 1
            response = sum(e[o : o + n] @ f[o] for o in range(w))
            at = response.argmax(axis=0)
            best.append(response[at, np.arange(FILTERS)])
            where.append(at)
        return np.concatenate(best) + self.bias, np.concatenate(where), e

    def logit(self, ids: np.ndarray) -> float:
        best = self.pooled(ids[:SLICE])[0]
        for at in range(SLICE, len(ids), SLICE):
            best = np.maximum(best, self.pooled(ids[at - max(WIDTHS) + 1 : at + SLICE])[0])
        return float(np.maximum(best, 0) @ self.output + self.intercept)

    def score(self, ids: np.ndarray, language: int) -> float:
        """The threshold of a text's language becomes THRESHOLD."""
        cut = np.log(THRESHOLD / (1 - THRESHOLD))
        return float(sigmoid(np.array(self.slope * (self.logit(ids) - self.thresholds[language]) + cut)))


def bucket_counts(docs: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """By label: texts that hold a bucket."""
    counts = np.zeros((2, 1 << BITS))
    for ids, y in zip(docs, label, strict=True):
        counts[y, np.unique(ids)] += 1
    return counts


def first_network(docs: list[np.ndarray], label: np.ndarray, seed: int = 11) -> Network:
    return network_of(bucket_counts(docs, label), label.mean() if len(label) else 0.0, seed)


def network_of(counts: np.ndarray, share: float, seed: int = 11) -> Network:
    """Random weights, but one dimension says how much more texts of label 1, a ``share`` of all, hold a bucket."""
    rng = np.random.default_rng(seed)
    expected = counts.sum(axis=0) * share
    lean = np.clip((counts[1] - expected) / np.sqrt(expected + 1), -3, 6) / 6
    embedding = rng.normal(0, 0.05, (1 << BITS, SIZE)).astype(np.float32)
    embedding[:, 0] += lean
    filters = [rng.normal(0, 0.2, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] += 0.5
    total = len(WIDTHS) * FILTERS
    return Network(embedding, filters, np.zeros(total, np.float32), rng.normal(0.1, 0.05, total).astype(np.float32), -1.0)


def first_sums(net: Network, eps: float = 1e-2) -> dict:
    """Sums of squared gradients, by parameter, before the first step."""
    sums = {"e": np.full_like(net.embedding, eps), "b": np.full_like(net.bias, eps), "o": np.full_like(net.output, eps), "i": eps}
    return sums | {"f": [np.full_like(f, eps) for f in net.filters]}


def learn(
    net: Network,
    docs: list[np.ndarray],
    label: np.ndarray,
    epochs: int = ROUNDS,
    rate: float = 0.05,
    seed: int = 5,
    sums: dict | None = None,
    share: list[float] | None = None,
) -> None:
    """Stochastic gradient steps of the logistic loss, one text at a time, with AdaGrad rates.

    Only the positions that pooling kept have gradients, so a step touches few embeddings.
    ``sums`` go on where earlier rounds ended; ``share`` is the weight of either label, by default from these rows.
    """
    rng = np.random.default_rng(seed)
    sums = first_sums(net) if sums is None else sums
    squares = sums["f"]
    share = [len(label) / (2 * max(1, (label == y).sum())) for y in (0, 1)] if share is None else share
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids = docs[i]
            best, where, e = net.pooled(ids)
            h = np.maximum(best, 0)
            p = sigmoid(np.array(h @ net.output + net.intercept))
            g = float(p - label[i]) * share[label[i]]
            back = g * net.output * (best > 0)
            d = g * h
            sums["o"] += d * d
            net.output -= rate * d / np.sqrt(sums["o"])
            sums["b"] += back * back
            net.bias -= rate * back / np.sqrt(sums["b"])
            sums["i"] += g * g
            net.intercept -= rate * g / np.sqrt(sums["i"])
            at, step_e = [], []
            for k, w in enumerate(WIDTHS):
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                f, b = net.filters[k], back[part]
                for o in range(w):
                    pos = where[part] + o
                    inside = pos < len(ids)
                    at.append(ids[pos[inside]])
                    step_e.append((b[:, None] * f[o].T)[inside])
                    d = e[pos].T * b
                    squares[k][o] += d * d
                    f[o] -= rate * d / np.sqrt(squares[k][o])
            rows = np.concatenate(at)
            for part in range(3):
                steps = np.concatenate(step_e)
                np.add.at(sums["e"], rows[:, part], steps * steps)
                np.add.at(net.embedding, rows[:, part], -rate * steps / np.sqrt(sums["e"][rows[:, part]]))


def best_threshold(logits: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the largest F1, halfway between its neighbours."""
    order = np.argsort(-logits, kind="stable")
    x, y, w = logits[order], label[order], weight[order]
    hit = np.cumsum(w * y)
    f1 = 2 * hit / (np.cumsum(w) + (w * y).sum())
    f1[:-1][x[:-1] == x[1:]] = -1
    k = int(f1.argmax())
    return float((x[k] + x[k + 1]) / 2) if k + 1 < len(x) else float(x[k] - 1)


def constant_network(ones: int, n: int) -> Network:
    """Every score is the share of label 1."""
    net = network_of(np.zeros((2, 1 << BITS)), 0.0)
    net.output[:] = 0
    net.intercept = 0.0
    share = (ones + 1e-3) / (n + 1) if n else 1e-3
    net.thresholds -= np.log(share / (1 - share)) - np.log(THRESHOLD / (1 - THRESHOLD))
    return net


def _unpacked(rows) -> tuple[list[np.ndarray], np.ndarray]:
    """Tokens, as they lie in the rows, and labels."""
    return [np.frombuffer(r["__x"], np.uint16).reshape(-1, 3) for r in rows], np.array([r["__y"] for r in rows], dtype=int)


def _arrays(net: Network, sums: dict) -> list[np.ndarray]:
    """The parameters and the sums of squares, all but those of the intercept."""
    return [net.embedding, *net.filters, net.bias, net.output, sums["e"], *sums["f"], sums["b"], sums["o"]]


def parts(net: Network, sums: dict) -> Iterator[tuple[int, np.ndarray]]:
    """What a shard learnt as numbered pieces of at most ``PIECE`` numbers; number 0 has the intercept's two."""
    yield 0, np.array([net.intercept, sums["i"]])
    flat = np.concatenate([x.ravel() for x in _arrays(net, sums)])
    for at in range(0, len(flat), PIECE):
        yield at // PIECE + 1, flat[at : at + PIECE]


def put_together(net: Network, sums: dict, pieces: dict[int, np.ndarray]) -> None:
    """``net`` and ``sums`` take the averages of all shards."""
    net.intercept, sums["i"] = float(pieces[0][0]), pieces[0][1]
    flat, at = np.concatenate([pieces[k] for k in range(1, len(pieces))]), 0
    for x in _arrays(net, sums):
        x[...] = flat[at : at + x.size].reshape(x.shape)
        at += x.size


def learn_shards(learnt: RDD, net: Network, share: list[float]) -> None:
    """Rounds in which every shard (its rows, together and in order of tokens) learns from the common network; then the average.

    What the shards learnt is added piece by piece, in many tasks, so that a record is small and the driver
    gets one network a round, however many shards there are.
    """
    sums = first_sums(net)
    tasks = min(learnt.getNumPartitions(), ADDING)
    for round_ in range(ROUNDS):
        state = learnt.context.broadcast((net, sums))

        def one(rows, round_=round_, state=state):
            for _, group in groupby(rows, key=lambda r: r["__shard"]):
                own, squares = pickle.loads(pickle.dumps(state.value))
                learn(own, *_unpacked(list(group)), 1, seed=5 + round_, sums=squares, share=share)
                yield from parts(own, squares)

        def added(pieces):
            # Added as doubles, so that the order of the shards doesn't show in the single precision of the average.
            totals, shards = {}, Counter()
            for k, x in pieces:
                totals[k] = totals.get(k, 0.0) + x.astype(float)
                shards[k] += 1
            for k, total in totals.items():
                yield k, (total / shards[k]).astype(np.float32)

        averages = learnt.mapPartitions(one).partitionBy(tasks).mapPartitions(added)
        put_together(net, sums, dict(averages.collect()))
        state.destroy()


def calibrate(net: Network, out: DataFrame, rare: float = 1.0, least: int = 20) -> None:
    """Curve and thresholds from counts of the rows' logits, by language and label.

    ``rare`` is what a row of label 1 stands for, a row of label 0 standing for one. A language with
    fewer than ``least`` rows of either class takes the threshold of all together.
    """
    shared = out.sparkSession.sparkContext.broadcast(net)

    def judged(batches):
        for batch in batches:
            rows = batch.select(["__x", "__y"]).to_pylist()
            logits = np.array([shared.value.logit(ids) for ids in _unpacked(rows)[0]])
            step = np.rint(np.clip(logits, -LIMIT, LIMIT) * GRID).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(step), batch.column("__k"), batch.column("__y")], names=["step", "k", "y"])

    found = out.mapInArrow(judged, "step int, k int, y int").groupBy("step", "k", "y").count().toArrow()
    shared.destroy()
    found = found.sort_by([(c, "ascending") for c in ("step", "k", "y")])
    step, language, y, n = (found.column(c).to_numpy() for c in ("step", "k", "y", "count"))
    logits = step / GRID
    net.slope = platt(logits, y, n)[0]
    weight = np.where(y == 1, rare, 1.0) * n
    net.thresholds[:] = best_threshold(logits, y, weight)
    for k in range(len(LANGUAGES)):
        own = language == k
        if min(n[own & (y == 1)].sum(), n[own & (y == 0)].sum()) >= least:
            net.thresholds[k] = best_threshold(logits[own], y[own], weight[own])


def train(docs: DataFrame, labels: DataFrame, doc_id: str, label: str, text: str = "text") -> Network:
    """Fits on all documents whose id ``labels`` holds with 0 or 1."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y"))
    read_docs = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text"))
    # By shuffle at any size: the labels grow with the table, and so would a broadcast of them.
    rows = read_docs.join(known.hint("shuffle_hash"), F.col("__doc") == F.col("__id")).select("__id", "__y", F.col("__text").alias(text))

    def start():
        tokens = Tokens()

        def read(texts):
            found = [tokens.read(t) for t in texts]
            return [[ids.astype(np.uint16).tobytes() for ids, _ in found], [k for _, k in found]]

        return read

    made = map_texts(rows, T.StructType([T.StructField("__x", T.BinaryType()), T.StructField("__k", T.IntegerType())]), start, text)
    dealt = F.xxhash64(F.col("__id").cast("string"), "__x")
    made = stored(made.withColumn("__out", F.pmod(dealt, F.lit(4)) == 0).withColumn("__deal", F.shiftright(dealt, 2)), "toxicity")
    sizes = {(r["__out"], r["__y"]): r["count"] for r in made.groupBy("__out", "__y").count().collect()}
    ones, n = sum(v for (_, y), v in sizes.items() if y == 1), sum(sizes.values())
    if ones in (0, n):
        return constant_network(ones, n)
    out, learnt = made.where("__out"), made.where("not __out")
    if len(sizes) < 4:  # one of the parts lacks a label
        out = learnt = made
    else:
        sizes = {key: v for key, v in sizes.items() if not key[0]}
    total = sum(sizes.values())
    of = [sum(v for (_, y), v in sizes.items() if y == label) for label in (0, 1)]

    def buckets(batches):
        counts = sum((bucket_counts(*_unpacked(b.select(["__x", "__y"]).to_pylist())) for b in batches), np.zeros((2, 1 << BITS)))
        y, at = counts.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[y, at].astype(np.int64))], names=["y", "at", "n"])

    counts = np.zeros((2, 1 << BITS))
    found = learnt.mapInArrow(buckets, "y int, at int, n long").groupBy("y", "at").agg(F.sum("n").alias("n")).toArrow()
    y, at, n = (found.column(c).to_numpy() for c in ("y", "at", "n"))
    counts[y, at] = n
    net = network_of(counts, of[1] / total)
    shards = -(-total // SHARD)
    keyed = learnt.select(F.pmod("__deal", F.lit(shards)).alias("__shard"), "__x", "__k", "__y")
    sorted_rows = keyed.repartition(shards, "__shard").sortWithinPartitions("__shard", "__x", "__k", "__y")
    dealt_rows = sorted_rows.rdd.persist(StorageLevel.DISK_ONLY)
    try:
        learn_shards(dealt_rows, net, [total / (2 * max(1, k)) for k in of])
    finally:
        dealt_rows.unpersist()
    calibrate(net, out)
    return net


def score(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``docs`` with score and the guessed language instead of the text."""
    parts = (net.embedding, net.filters, net.bias, net.output, net.intercept, net.slope, net.thresholds)
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def start():
        tokens, n = Tokens(), Network(*shared.value)

        def judge(texts):
            found = [tokens.read(t) for t in texts]
            return [[n.score(ids, k) for ids, k in found], [LANGUAGES[k] for _, k in found]]

        return judge

    return map_texts(docs, T.StructType([T.StructField("score", T.DoubleType()), T.StructField("language", T.StringType())]), start, text)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", FOLDS) != HELD_OUT)
    net = train(docs, labels, "doc_id", "toxic")
    scored = score(docs.withColumn("held_out", fold("doc_id", FOLDS) == HELD_OUT), net)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op10_toxicity": (op10_toxicity, None)}
