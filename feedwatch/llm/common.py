"""Helpers the operators share: words, token hashing, folds, bounded samples."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..conf import shared_dir

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed and return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = re.compile(r"[\x20\x09-\x0D]")
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def lower_ascii(text: str) -> str:
    """A-Z lower-cased, all else as it is; plain ``lower`` where the text is ASCII."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


class TokenHasher(dict):
    """32-bit hashes of strings, remembered up to ``limit`` strings at a time."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[token] = h = mix(zlib.crc32(token.encode("utf-8", "surrogatepass")))
        return h

    def array(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


class WordHasher(dict):
    """64-bit hashes of words, remembered up to ``limit`` words at a time."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def array(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mix(x: int) -> int:
    """Spreads a 32-bit hash, since crc32 of similar strings differs in few bits."""
    x = (x ^ (x >> 16)) * 0x45D9F3B & 0xFFFFFFFF
    x = (x ^ (x >> 16)) * 0x45D9F3B & 0xFFFFFFFF
    return x ^ (x >> 16)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read again.

    Cuts the lineage and lets several jobs read one result. The folder is shared, so
    a lost executor costs at most its running tasks.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """About ``limit`` rows, chosen by a hash of ``key``: all of them when there are no more."""
    n = rows.count()
    if n <= limit:
        return rows
    share = int(limit / n * 1_000_000)
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1_000_000)) < share)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def platt(margin: np.ndarray, label: np.ndarray, rows: np.ndarray | None = None, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of P(label = 1) over margins, by Newton steps with a small ridge; ``rows`` tells how many rows each stands for."""
    rows = np.ones(len(label)) if rows is None else rows
    n1 = float((rows * label).sum())
    n0 = float(rows.sum() - n1)
    if n0 == 0 or n1 == 0:
        return 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    w = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (rows * (p - target)) + 1e-3 * w
        hessian = (x * (rows * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def map_texts(rows: DataFrame, added: T.StructType, start: Callable[[], Callable], text: str = "text", step: int = 256) -> DataFrame:
    """``rows`` without its text, and with the columns that a Python function makes of each text.

    ``start()`` runs once in each task and returns ``f(texts) -> one list or array per
    column of added``; texts come ``step`` at a time, nulls as None. All other columns
    pass through as they are, so no id loses its type or precision.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    others = [c for c in rows.columns if c != text]
    schema = T.StructType([rows.schema[c] for c in others] + added.fields)
    types = [f.type for f in to_arrow_schema(added)]
    names = others + added.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                made = f(part.column(part.schema.get_field_index(text)).to_pylist())
                columns = [part.column(part.schema.get_field_index(c)) for c in others]
                columns += [pa.array(v, t) for v, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select(*others, text).mapInArrow(run, schema)
