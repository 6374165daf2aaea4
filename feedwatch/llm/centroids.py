"""Centroid clustering with ns-bounds: Lloyd's rounds that skip most distances, exactly.

Vectors are rounded to integers, so distances, sums and centroids are exact integers and the
result doesn't depend on the order of rows or the number of tasks.

* State. Vectors lie packed in blocks of ``BLOCK_ROWS``. For each vector a block holds its cluster, the
  squared distance to that cluster's centroid and the round it was computed in, and the
  squared distance to the nearest other centroid and its round.
* Bounds. All earlier centroids are kept. A centroid that was at distance d in round T is now at least d
  less, and at most d more, the length of its total displacement from round T to now: one
  norm of a difference, not the sum of the lengths of its steps, which is never shorter.
  Among the other centroids the longest such displacement counts. If the upper bound of the own
  centroid lies below the lower bound of the others, the vector stays.
* Otherwise the own distance is computed anew, and if that doesn't settle it, all distances are
  (a rescan). Bounds are compared with a margin wider than any rounding of their square roots,
  so a tie or a near tie is always rescanned, with integers.
* Rounds. A block also holds the sums and counts of its clusters; a round adds these up on the cluster and
  brings ``k * (dimension + 1)`` numbers to the driver. What is sent to tasks is the history of centroids,
  (rounds + 1) * k vectors. Each round writes the blocks anew to the shared folder and removes those of
  the round before.

Only vectors of ``DIMENSION`` components, none null, NaN or infinite, are kept; others have no result row.
Rounded components are kept within ``LIMIT`` either way, so that squared distances stay below 2^53, where
double arithmetic on integers is exact. Repeated rows are separate vectors. A null id hashes like
an empty one; equal hashes are ordered by their components. With fewer vectors than clusters there
are fewer centroids; an empty table gives an empty result. Extra columns aren't read. A sum of
distances above the largest long is given as that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..conf import shared_dir
from .common import table

K = 40
ROUNDS = 5
DIMENSION = 64
SCALE = 256
LIMIT = 1 << 22
SEED = "2"
BLOCK_ROWS = 4096
#: Rounding of a square root is below one part in 10^15; bounds must differ by more than this share to count.
MARGIN = 1e-9
_MOST = (1 << 63) - 1


def kept(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dimension: int = DIMENSION) -> DataFrame:
    """vec_id and ints of the usable vectors."""
    x = F.col(embedding)
    infinite = F.lit(float("inf"))
    unusable = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == infinite))
    ints = F.transform(x, lambda v: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(v.cast("double") * SCALE).cast("double"))).cast("int"))
    # `size` of a null array is no number, so null vectors go too
    return vectors.where(x.isNotNull() & (F.size(x) == dimension)).where(~unusable).select(F.col(vec_id).alias("vec_id"), ints.alias("ints"))


def first_centroids(rows: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """The vectors with the ``k`` smallest hashes of their ids, in that order."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = rows.select(place.alias("place"), "ints").orderBy("place", "ints").limit(k).collect()
    return np.array([r["ints"] for r in chosen], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All squared distances. Every term is an integer below 2^53, so the matrix product is exact."""
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * (x @ c.T)


class History:
    """The centroids of all rounds so far, and how far each has moved since any of them."""

    def __init__(self, centroids: list[np.ndarray]):
        self.centroids = [c.astype(np.float64) for c in centroids]
        self.now = self.centroids[-1]
        self.moved = np.array([np.sqrt(((self.now - c) ** 2).sum(1)) for c in self.centroids])
        k = len(self.now)
        others = np.broadcast_to(self.moved[:, None, :], (len(centroids), k, k)).copy()
        others[:, np.arange(k), np.arange(k)] = 0.0
        #: others[T, a]: the longest displacement since round T among the centroids but a
        self.others = others.max(axis=2)


def rescan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), its squared distance and that of the nearest other one."""
    d = squared(x, c)
    at = d.argmin(1)
    rows = np.arange(len(x))
    own = d[rows, at]
    d[rows, at] = np.inf
    return at, own, d.min(1)


def reassign(x: np.ndarray, state: dict, history: History) -> dict:
    """The state of a block of vectors against the newest centroids."""
    now = len(history.centroids) - 1
    if state is None:
        at, own, other = rescan(x, history.now)
        fresh = np.full(len(x), now, np.int8)
        return {"cluster": at, "own": own, "own_round": fresh, "other": other, "other_round": fresh.copy(), "rescanned": len(x), "renewed": 0}
    at, own, own_round = state["cluster"].copy(), state["own"].copy(), state["own_round"].copy()
    other, other_round = state["other"].copy(), state["other_round"].copy()
    lower = np.sqrt(other) - history.others[other_round, at]

    def settled(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return upper * (1 + MARGIN) + MARGIN < lower[rows] * (1 - MARGIN)

    rows = np.arange(len(x))
    left = rows[~settled(rows, np.sqrt(own) + history.moved[own_round, at])]
    own[left] = ((x[left] - history.now[at[left]]) ** 2).sum(1)
    own_round[left] = now
    again = left[~settled(left, np.sqrt(own[left]))]
    if len(again):
        at[again], own[again], other[again] = rescan(x[again], history.now)
        own_round[again] = other_round[again] = now
    return {"cluster": at, "own": own, "own_round": own_round, "other": other, "other_round": other_round, "rescanned": len(again), "renewed": len(left)}


_STATE = {"cluster": np.int64, "own": np.float64, "own_round": np.int8, "other": np.float64, "other_round": np.int8}


def block_schema(vec_id: T.DataType) -> T.StructType:
    fields = [T.StructField("ids", T.ArrayType(vec_id)), T.StructField("vectors", T.BinaryType()), T.StructField("width", T.IntegerType())]
    fields += [T.StructField(c, T.BinaryType()) for c in _STATE]
    return T.StructType(fields + [T.StructField("sums", T.BinaryType()), T.StructField("rescanned", T.LongType()), T.StructField("renewed", T.LongType())])


def as_block(ids: list, x: np.ndarray, width: int, state: dict, history: History) -> list:
    k = len(history.now)
    chosen = np.zeros((k, len(x)))
    chosen[state["cluster"], np.arange(len(x))] = 1.0
    # BLOCK_ROWS * LIMIT is far below 2^53: exact
    sums = np.column_stack([chosen @ x, chosen.sum(1)]).astype(np.int64)
    return [ids, x.astype(f"<i{width}").tobytes(), width, *[state[c].astype(t).tobytes() for c, t in _STATE.items()], sums.tobytes(), state["rescanned"], state["renewed"]]


def packed(rows: DataFrame, centroids: list[np.ndarray], dimension: int = DIMENSION, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of vectors, assigned to the first centroids."""
    schema = block_schema(rows.schema["vec_id"].dataType)
    types, names = [to_arrow_type(f.dataType) for f in schema.fields], schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history = History(centroids)
        for b in batches:
            for at in range(0, b.num_rows, block_rows):
                part = b.slice(at, block_rows)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)
                width = 2 if np.abs(x).max() < 1 << 15 else 4
                made = as_block(part.column(0).to_pylist(), x, width, reassign(x, None, history), history)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made, types, strict=True)], names=names)

    return rows.select("vec_id", "ints").mapInArrow(run, schema)


def unpacked(row: dict, dimension: int) -> tuple[np.ndarray, dict]:
    x = np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(-1, dimension).astype(np.float64)
    return x, {c: np.frombuffer(row[c], t) for c, t in _STATE.items()}


def reassigned(blocks: DataFrame, centroids: list[np.ndarray], dimension: int = DIMENSION) -> DataFrame:
    """The blocks against the newest of ``centroids``."""
    types, names = [to_arrow_type(f.dataType) for f in blocks.schema.fields], blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history = History(centroids)
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                x, state = unpacked(row, dimension)
                made = as_block(row["ids"], x, row["width"], reassign(x, state, history), history)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made, types, strict=True)], names=names)

    return blocks.mapInArrow(run, blocks.schema)


def totals(blocks: DataFrame, k: int, dimension: int = DIMENSION) -> tuple[np.ndarray, np.ndarray]:
    """Sums (k x dimension) and counts of all clusters, added up in tasks and then on the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * (dimension + 1), np.int64)
        for b in batches:
            for v in b.column(0):
                total += np.frombuffer(v.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["cell", "total"])

    parts = blocks.select("sums").mapInArrow(run, "cell int, total long")
    found = np.zeros(k * (dimension + 1), object)
    for r in parts.groupBy("cell").agg(F.sum("total").alias("total")).collect():
        found[r["cell"]] = r["total"]
    found = found.reshape(k, dimension + 1)
    return found[:, :dimension], found[:, dimension]


def recentred(centroids: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The means of non-empty clusters, rounded down; empty ones stay."""
    return np.array([[s // n for s in row] if n else list(old) for row, n, old in zip(sums, counts, centroids, strict=True)], np.int64)


def removed(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clustered(rows: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = SEED, dimension: int = DIMENSION, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, list[np.ndarray]]:
    """Blocks assigned to the last centroids, and the centroids of all rounds. No centroids: no rows."""
    spark = rows.sparkSession
    history = [first_centroids(rows, k, seed)]
    k = len(history[0])
    if not k:
        return spark.createDataFrame([], block_schema(rows.schema["vec_id"].dataType)), history
    folder = shared_dir(spark, "centroids")
    blocks = packed(rows, history, dimension, block_rows)
    for number in range(rounds + 1):
        path = f"{folder}/round={number}"
        blocks.write.mode("overwrite").parquet(path)
        if number:
            removed(spark, f"{folder}/round={number - 1}")
        held = spark.read.schema(blocks.schema).parquet(path)
        if number < rounds:
            history.append(recentred(history[-1], *totals(held, k, dimension)))
            blocks = reassigned(held, history, dimension)
    return held, history


def distances(blocks: DataFrame, centroids: np.ndarray, dimension: int = DIMENSION) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    schema = T.StructType([T.StructField("vec_id", blocks.schema["ids"].dataType.elementType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    types, names = [to_arrow_type(f.dataType) for f in schema.fields], schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                x, state = unpacked(row, dimension)
                d = ((x - centroids[state["cluster"]]) ** 2).sum(1).astype(np.int64)
                made = [row["ids"], state["cluster"], d]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, types, strict=True)], names=names)

    return blocks.mapInArrow(run, schema)


def clusters(rows: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = SEED, dimension: int = DIMENSION, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector of ``kept``."""
    blocks, history = clustered(rows, k, rounds, seed, dimension, block_rows)
    last = history[-1]
    found = distances(blocks, last, dimension)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()
    inertia = {r["cluster"]: int(r["inertia"]) for r in sums}
    # one entry for each centroid: k at most
    own = [min(inertia.get(c, 0), _MOST) for c in range(len(last))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in last.tolist()]
    of = F.col("cluster")
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        F.get(F.array(*[F.lit(v).cast("long") for v in own]), of).cast("long").alias("cluster_inertia"),
        F.lit(min(sum(inertia.values()), _MOST)).cast("long").alias("inertia"),
        F.get(F.array(*[F.lit(v) for v in digests]), of).cast("string").alias("centroid_sha256"),
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(kept(table(spark, sf_dir, "embeddings")))


QUERIES = {"op13_centroids": (op13_centroids, None)}
