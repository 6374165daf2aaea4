"""Sharding against a plain binary search with a plain greedy walk over all groups."""

import hashlib
import random
import zlib

import brute
import pytest
from conftest import SF
from pyspark.sql import functions as F

from feedwatch.llm import registry, sharding
from feedwatch.llm.common import table


def size(text):
    return len((text or "").encode()) + 16


def expected(texts, shards):
    """Shard of every text: large groups alone, largest first; the rest cut greedily at the smallest capacity."""
    groups = {}
    for t in texts:
        place = int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)
        groups[place] = groups.get(place, 0) + size(t)
    rest, found = sum(groups.values()), {}
    for place, n in sorted(groups.items(), key=lambda g: (-g[1], g[0])):
        if len(found) == shards - 1 or n * (shards - len(found)) < rest:
            break
        found[place] = len(found)
        rest -= n
    line, first = [g for g in sorted(groups.items()) if g[0] not in found], len(found)

    def cut(capacity):
        at, held, placed = first, 0, {}
        for place, n in line:
            if n > capacity:
                return None
            if held + n > capacity:
                at, held = at + 1, 0
            held += n
            placed[place] = at
        return placed if at < shards else None

    low, high = 0, sum(groups.values())
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if cut(middle) is not None else (middle, high)
    return found | (cut(high) or {})


def held_against(rows, out, shards):
    want = expected([t for _, t in rows], shards)
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append(r)
    assert len(out) == len(rows)
    for doc_id, text in rows:
        place = int(hashlib.md5((text or "").encode()).hexdigest()[:15], 16)
        crc = None if text is None else zlib.crc32(text.encode())
        assert (want[place], size(text), crc) in [(r["shard"], r["size"], r["text_crc32"]) for r in got[doc_id]]
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("cell_bits", [sharding.CELL_BITS, 4])
def test_query_equals_brute_force(spark, monkeypatch, cell_bits):
    monkeypatch.setattr(sharding.capacity, "__defaults__", (cell_bits,))
    monkeypatch.setattr(sharding.shard_rows, "__defaults__", (sharding.SHARDS, cell_bits, 40))
    out = registry.queries()["op12_sharding"](spark, SF)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    held_against(rows, out.collect(), sharding.SHARDS)


def test_large_groups_equal_brute_force(spark):
    rng = random.Random(5)
    for copies, shards in ((200, 7), (60, 5), (400, 3)):
        texts = ["hot" * 30] * copies + ["warm" * 9] * (copies // 3) + ["".join(rng.choices("abé", k=rng.randrange(60))) for _ in range(150)]
        rows = list(enumerate(texts))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        held_against(rows, sharding.shard_rows(sharding.sized(df), shards, 5, 50).collect(), shards)


def test_equal_sizes_fill_all_shards(spark):
    rows = [(i, f"{i:04}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard_rows(sharding.sized(df), 40).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert sorted(r["shard"] for r in out) == list(range(40)) and {r["n"] for r in out} == {60}


def test_reruns_agree(spark):
    run = registry.queries()["op12_sharding"]
    assert sorted(map(str, run(spark, SF).collect())) == sorted(map(str, run(spark, SF).repartition(3).collect()))


def test_awkward_rows(spark):
    docs = brute.edge_docs(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    held_against(rows, sharding.shard_rows(sharding.sized(docs)).collect(), sharding.SHARDS)
    same = spark.createDataFrame([(None, None, "1", 1, "p")] * 50 + [(None, "", "2", 2, None)] * 3 + [(1, "a", None, None, "q")], "doc_id long, text string, size string, shard int, place string")
    out = sharding.shard_rows(sharding.sized(same), bucket_rows=5).collect()
    assert len(out) == 54 and len({r["shard"] for r in out if r["doc_id"] is None}) == 1
    assert sharding.shard_rows(sharding.sized(brute.empty_docs(spark))).count() == 0
