"""N-gram Jaccard join with a MinHash LSH forest.

Documents are sets of five-word shingles (a shorter text is one shingle of all its words).
Documents of the same text are one node, so copies are never compared. A node's MinHash
signature is cut into labels of ``DEPTH`` hashes, one for each trie; a label is a path in
a prefix trie. All labels of a trie are sorted, so that every subtree is a run of neighbours, and
neighbours are compared: the number of hashes they share is the depth of the subtree that
holds both. Matched prefixes are shortened from the whole label, hash by hash, until the share
of pairs at the threshold that meet in at least one trie, 1 - (1 - s^depth)^tries, reaches the target
recall; where not even single hashes reach it, tries are added (see ``forest``).

Neighbours that share the shortened prefix are candidates. The chains of neighbours of all tries
are joined to components. The sort is by range of trie, label and node, so a
subtree of any size is spread over tasks, and candidates cost a row for each node and trie and not
one for each pair. Components are then verified exactly, in blocks: a component of any size
is cut into blocks by a hash, each pair of blocks is one task's group, and what comes out of it is
a row for each node: its number of verified links there and the block's component that they
join it to. All links inside a component are verified, also those of pairs whose prefixes
differ. So a group of m near copies costs m^2 comparisons (as a matrix product), m rows of a
block's size for each block, and no more.

The result has a row for each document: its class (smallest id of the documents linked to it
directly or through others, copies included) and its number of links (documents with a
similarity of ``THRESHOLD`` or more, copies included).

Nulls and texts without a word have no shingles: they link to nothing and are a class of
their own. Ids needn't be unique: each row is a document; a class without any id has the id null. An empty
table gives an empty result. Extra columns aren't read. Shingles are compared by 64-bit
hashes, texts by MD5.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, WordHasher, map_texts, stored, table

WORDS = 5
THRESHOLD = 0.8
#: Tries to start with, hashes of a label, and the most tries that a low threshold may take.
TRIES = 20
DEPTH = 6
MOST_TRIES = 500
RECALL = 0.9999
#: Nodes, and shingles, that a block holds on average at most.
BLOCK_NODES = 256
BLOCK_SHINGLES = 500_000
#: Shingles that are compared at a time in a block.
COLUMNS = 4096

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, hashes: WordHasher, size: int = WORDS) -> np.ndarray:
    """The distinct hashed shingles of a whole text, sorted."""
    found = WORD.findall(text) if text else []
    if not found:
        return np.zeros(0, np.uint64)
    ids = hashes.array(found)
    size = min(size, len(ids))
    n = len(ids) - size + 1
    mixed = np.full(n, len(found) if len(found) < WORDS else 0, np.uint64)
    for k in range(size):
        mixed = (mixed ^ ids[k : k + n]) * _STEP
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


@cache
def hash_family(tries: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of tries x DEPTH hash functions."""
    rng = np.random.default_rng(20_250_101)
    return rng.integers(1, 1 << 63, tries * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, tries * DEPTH, dtype=np.uint64)


def signature(found: np.ndarray, tries: int = TRIES) -> np.ndarray:
    """tries x DEPTH smallest hashes, 16 bits of each; long texts go through in parts."""
    multiply, add = hash_family(tries)
    least = np.full(tries * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        part = found[at : at + 2048, None] * multiply + add
        least = np.minimum(least, (part ^ part >> np.uint64(32)).min(axis=0))
    return ((least * _STEP) >> np.uint64(48)).astype(">u2").reshape(tries, DEPTH)


def reached(threshold: float, depth: int, tries: int) -> float:
    """Share of pairs at the threshold that share a prefix of ``depth`` hashes in some trie."""
    return 1 - (1 - threshold**depth) ** tries


def forest(threshold: float = THRESHOLD, recall: float = RECALL, tries: int = TRIES) -> tuple[int, int]:
    """(tries, depth): the longest prefix that reaches the recall, with more tries where none does.

    A threshold that even ``MOST_TRIES`` tries don't serve is an error.
    """
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("the threshold lies in (0, 1], the recall in (0, 1)")
    depth = DEPTH
    while depth > 1 and reached(threshold, depth, tries) < recall:
        depth -= 1
    while reached(threshold, depth, tries) < recall:
        tries += 1
        if tries > MOST_TRIES:
            raise ValueError(f"{MOST_TRIES} tries don't find pairs of similarity {threshold} with recall {recall}")
    return tries, depth


def sketches(docs: DataFrame, doc_id: str, text: str, tries: int = TRIES) -> DataFrame:
    """id, node (MD5 of the text), n_shingles and labels (a binary path for each trie)."""
    added = T.StructType([T.StructField("n_shingles", T.IntegerType()), T.StructField("labels", T.ArrayType(T.BinaryType()))])

    def start():
        hashes = WordHasher()

        def sketch(texts):
            sets = [shingles(t, hashes) for t in texts]
            return [[len(s) for s in sets], [[row.tobytes() for row in signature(s, tries)] if len(s) else [] for s in sets]]

        return sketch

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), node_of(text).alias("node"), F.col(text).alias("__text"))
    return map_texts(rows, added, start, "__text")


def node_of(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def shared_hashes(trie: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Hashes that each label, from the second on, shares with the one before it; 0 across tries."""
    same = (labels[1:] == labels[:-1]) & (trie[1:] == trie[:-1])[:, None]
    return np.cumprod(same, axis=1).sum(axis=1)


def neighbours(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of sorted neighbours that share ``depth`` hashes; the first and last row as they are, with b null."""
    schema = pa.schema([("trie", pa.int32()), ("label", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
    first = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        trie, label, node = (batch.column(c).to_pylist() for c in ("trie", "label", "node"))
        if last is None:
            first = (trie[0], label[0], node[0])
        else:
            trie, label, node = [last[0], *trie], [last[1], *label], [last[2], *node]
        last = (trie[-1], label[-1], node[-1])
        shared = shared_hashes(np.array(trie), np.frombuffer(b"".join(label), ">u2").reshape(len(label), -1))
        met = np.flatnonzero(shared >= depth)
        none = pa.nulls(len(met))
        a, b = ([node[i] for i in at.tolist()] for at in (met + 1, met))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int32()), none.cast(pa.binary()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=schema)
    ends = [first] if first == last else [first, last]
    if first is not None:
        yield pa.RecordBatch.from_pylist([{"trie": t, "label": x, "a": n, "b": None} for t, x, n in ends], schema)


def candidate_edges(nodes: DataFrame, depth: int) -> DataFrame:
    """(a, b) of nodes that are neighbours in a sorted trie and share its prefix of ``depth`` hashes.

    Ranges of the sort are compared inside themselves; the two ends of each, a few rows for each
    partition whatever the data, are compared with each other afterwards.
    """
    each = nodes.select("node", F.posexplode("labels").alias("trie", "label")).select("trie", "label", "node")
    runs = each.repartitionByRange("trie", "label", "node").sortWithinPartitions("trie", "label", "node")
    found = stored(runs.mapInArrow(lambda batches: neighbours(batches, depth), "trie int, label binary, a binary, b binary"), "neighbours")
    order = Window.orderBy("trie", "label", "a")
    ends = found.where("b IS NULL").select("trie", F.substring("label", 1, 2 * depth).alias("prefix"), "a", "label")
    before = ends.withColumn("b", F.when((F.lag("trie").over(order) == F.col("trie")) & (F.lag("prefix").over(order) == F.col("prefix")), F.lag("a").over(order)))
    return found.where("b IS NOT NULL").select("a", "b").unionAll(before.where("b IS NOT NULL").select("a", "b")).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node that ``edges`` (a, b) hold; the root is the smallest node.

    Large-star and small-star steps in turn until nothing moves: each is a grouped minimum
    and a join, and the number of rounds grows with the logarithm of a path's length.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), name)
    before = None
    while True:
        both = edges.unionAll(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionAll(least.select("a", "m"))
        edges = stored(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select("b", "b").distinct())


def intersections(rows: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over the shingles both sides hold."""
    out = np.zeros((len(rows), len(others)), np.float32)
    sides = []
    for side in (rows, others):
        sides.append((np.concatenate(side), np.repeat(np.arange(len(side)), [len(s) for s in side])))
    kinds, times = np.unique(sides[0][0], return_counts=True)
    kinds = np.intersect1d(kinds[times > 1] if rows is others else kinds, sides[1][0])
    placed = []
    for ids, owner in sides:
        at = np.searchsorted(kinds, ids)
        at[at == len(kinds)] = 0
        held = kinds[at] == ids if len(kinds) else np.zeros(len(ids), bool)
        order = np.argsort(at[held], kind="stable")
        placed.append((at[held][order], owner[held][order]))
    for first in range(0, len(kinds), COLUMNS):
        dense = []
        for (at, owner), side in zip(placed, (rows, others), strict=True):
            lo, hi = np.searchsorted(at, [first, first + COLUMNS])
            m = np.zeros((len(side), min(COLUMNS, len(kinds) - first)), np.float32)
            m[owner[lo:hi], at[lo:hi] - first] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    if rows is others:
        out[np.arange(len(rows)), np.arange(len(rows))] = [len(s) for s in rows]
    return out


def similar(rows: list[np.ndarray], others: list[np.ndarray], threshold: float) -> np.ndarray:
    common = intersections(rows, others).astype(np.float64)
    a, b = (np.array([len(s) for s in side], float) for side in (rows, others))
    return common >= threshold * (a[:, None] + b[None, :] - common) - 1e-9


def roots(linked: np.ndarray, nodes: list[bytes]) -> list[bytes]:
    """Each node's smallest node among those joined to it by ``linked`` (square, symmetric)."""
    n = len(nodes)
    order = sorted(range(n), key=nodes.__getitem__)
    root = np.full(n, -1)
    for s in order:
        if root[s] < 0:
            frontier = np.zeros(n, bool)
            frontier[s] = True
            while frontier.any():
                root[frontier] = s
                frontier = linked[frontier].any(axis=0) & (root < 0)
    return [nodes[r] for r in root]


def verify_block(batch: pa.Table, threshold: float) -> list[tuple[bytes, bytes, int]]:
    """(node, root, links) of the nodes of a pair of blocks that have verified links there."""
    hashes = WordHasher()
    seen: dict[bytes, tuple[int, int, np.ndarray]] = {}
    columns = [batch.column(c).to_pylist() for c in ("node", "block", "copies", "text")]
    for node, block, copies, text in zip(*columns, strict=True):
        if node not in seen:
            seen[node] = (block, copies, shingles(text, hashes))
    first, second = batch.column("first")[0].as_py(), batch.column("second")[0].as_py()
    nodes = [n for n in seen if seen[n][0] == first]
    others = nodes if first == second else [n for n in seen if seen[n][0] == second]
    if not nodes or not others:
        return []
    sides = [[seen[n][2] for n in side] for side in (nodes, others)]
    if others is nodes:
        linked = similar(sides[0], sides[0], threshold)
        np.fill_diagonal(linked, False)
        square, every = linked, nodes
    else:
        linked = similar(sides[0], sides[1], threshold)
        every, n = nodes + others, len(nodes)
        square = np.zeros((len(every), len(every)), bool)
        square[:n, n:], square[n:, :n] = linked, linked.T
    copies = np.array([seen[n][1] for n in every])
    links = (square * copies[None, :]).sum(axis=1)
    return [(n, r, int(k)) for n, r, k in zip(every, roots(square, every), links, strict=True) if k]


def verified(docs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(node, root, links) for pairs of blocks, of ``members`` (node, root, id, copies, n_shingles).

    ``docs`` has id, node and text; a member's text is that of the document ``id``.
    """
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    placed = members.join(sizes.select("root", blocks.alias("blocks")), "root")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # the document is the one whose id and text the node has
    texts = docs.join(placed.select(F.col("node").alias("__node"), F.col("id").alias("__id"), "root", "block", "blocks", "copies"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("node") == F.col("__node")))
    dealt = texts.select("root", "node", "block", "copies", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("root", "node", "block", "copies", "text", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    schema = pa.schema([("node", pa.binary()), ("root", pa.binary()), ("links", pa.int64())])

    def check(group: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([dict(zip(schema.names, row, strict=True)) for row in verify_block(group, threshold)], schema)

    return dealt.groupBy("root", "first", "second").applyInArrow(check, "node binary, root binary, links long")


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, node, class_id, n_links, n_copies, class (a key that is never null) and first of every row.

    first marks the one document of each class that stays when copies go: the smallest
    id, nulls last, then the smallest node. Rows alike in id and text are all marked.
    """
    tries, depth = forest(threshold)
    sketched = stored(sketches(docs, doc_id, text, tries), "sketches")
    nodes = sketched.groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("labels").alias("labels"))
    nodes = stored(nodes, "nodes")
    met = components(candidate_edges(nodes.where("n_shingles > 0"), depth), "candidates")
    nodes = nodes.drop("labels")
    members = met.join(nodes, "node")
    source = docs.select(F.col(doc_id).cast("long").alias("id"), node_of(text).alias("node"), F.col(text).alias("text"))
    links = stored(verified(source, members, threshold), "links")
    classes = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), "classes")
    total = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = nodes.join(classes, "node", "left").join(total, "node", "left")
    # a text without a shingle links to nothing, not even to its copies
    empty = F.col("n_shingles") == 0
    joined = joined.withColumn("class", F.coalesce("root", "node")).withColumn(
        "n_links", F.when(empty, 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    )
    named = joined.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "node")).alias("least"))
    by_node = joined.join(named, "class").select("node", "class", "least", "n_links", "copies", empty.alias("empty"))
    out = sketched.select("id", "node").join(by_node, "node")
    return out.select(
        F.col("id").alias(doc_id),
        "node",
        F.when(F.col("empty"), F.col("id")).otherwise(F.col("least.id")).alias("class_id"),
        "n_links",
        F.col("copies").alias("n_copies"),
        "class",
        (F.col("empty") | (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("node") == F.col("least.node")))).alias("first"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


QUERIES = {"op3_jaccard_join": (op3_jaccard_join, None)}
