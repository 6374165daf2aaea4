"""The manifest against a plain tree that hashes level by level."""

import hashlib
import zlib
from collections import defaultdict

import brute
import pytest
from conftest import SF
from pyspark.sql import functions as F

from feedwatch.llm import merkle, registry
from feedwatch.llm.common import table


def h(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8")).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fan=16):
    """The root, and each node's witness as (left, right) lists."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k - k % fan : k - k % fan + fan]
            paths[i].append((run[: k % fan], run[k % fan + 1 :]))
        nodes = [h(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
        at = [k // fan for k in at]
    return nodes[0], paths


def expected(rows):
    """Sorted result rows of documents (doc_id, source, lang, n_chars, text)."""
    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda x: x[:3])
    own = {s: tree([x[2] for x in sources[s]]) for s in order}
    root, upper = tree([own[s][0] for s in order])
    out = []
    for s, above in zip(order, upper, strict=True):
        for (_, _, node, r), below in zip(sources[s], own[s][1], strict=True):
            path = below + above
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = r[4].translate(brute.LOWER) if changed and r[4] is not None else r[4]
            at = leaf((*r[:4], text))
            for left, right in path:
                at = h(*left, at, *right)
            proof = h(*[x for left, right in path for x in left + right])
            out.append((r[0], node, own[s][0], root, proof, at, at == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def rows_of(docs):
    return [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]


def test_query_equals_brute_force(spark):
    out = registry.queries()["op11_merkle"](spark, SF)
    assert out.columns == COLUMNS
    want = expected(rows_of(table(spark, SF, "documents")))
    assert got(out) == want and {w[-1] for w in want} == {True, False}


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of two levels of runs of three, so that small tables have several stages."""
    monkeypatch.setattr(merkle, "FAN", 3)
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)


def made(n, source="s", start=0):
    return [(i, source, None if i % 4 else "en", i % 7, f"Text É {i}") for i in range(start, start + n)]


def plain(rows, fan):
    original = tree.__defaults__
    tree.__defaults__ = (fan,)
    try:
        return expected(rows)
    finally:
        tree.__defaults__ = original


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_several_stages_equal_brute_force(spark, small_blocks, tmp_path):
    sources = [("a", 1), ("b", 3), ("c", 9), ("d", 10), (None, 82), ("é", 28), ("", 4), *[(f"z{i}", 2) for i in range(20)]]
    rows = [r for k, (s, n) in enumerate(sources) for r in made(n, s, 1000 * k)]
    manifest = merkle.Manifest(spark, str(tmp_path / "m"))
    manifest.append(merkle.leaves(spark.createDataFrame(rows, SCHEMA)), 0)
    assert got(manifest.proofs()) == plain(rows, 3)


def test_appends_give_the_same_as_one(spark, small_blocks, tmp_path):
    manifest, sent = merkle.Manifest(spark, str(tmp_path / "m")), []
    for number, sizes in enumerate([(1, 5, 9), (8, 4, 0), (0, 1, 13), (20, 0, 1)]):
        rows = [r for s, n in zip("abc", sizes, strict=True) for r in made(n, s, 100 * number + 1000 * ord(s))]
        manifest.append(merkle.leaves(spark.createDataFrame(rows, SCHEMA)), number)
        if number == 2:  # once more, as after a lost driver
            manifest.append(merkle.leaves(spark.createDataFrame(rows, SCHEMA)), number)
        sent += rows
        assert got(manifest.proofs()) == plain(sent, 3)


def test_only_unfinished_blocks_are_read_again(spark, small_blocks, tmp_path):
    manifest = merkle.Manifest(spark, str(tmp_path / "m"))
    manifest.append(merkle.leaves(spark.createDataFrame(made(40), SCHEMA)), 0)
    manifest.append(merkle.leaves(spark.createDataFrame(made(3, start=40), SCHEMA)), 1)
    again = spark.read.parquet(str(tmp_path / "m/append=1")).collect()
    assert [(r["block"], r["n"]) for r in again] == [(4, 7)]


def test_stream_of_appends(spark, tmp_path):
    rows = made(50) + made(20, "t", 100)
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[0] % 100 // 20 == k], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    manifest = merkle.Manifest(spark, str(tmp_path / "m"))
    merkle.start_appends(stream, manifest).awaitTermination()
    assert got(manifest.proofs()) == expected(rows)


def test_awkward_rows(spark, tmp_path):
    docs = brute.edge_docs(spark)
    manifest = merkle.Manifest(spark, str(tmp_path / "m"))
    manifest.append(merkle.leaves(docs), 0)
    assert got(manifest.proofs()) == expected(rows_of(docs))
    empty = merkle.Manifest(spark, str(tmp_path / "e"))
    empty.append(merkle.leaves(brute.empty_docs(spark)), 0)
    assert empty.proofs().count() == 0
