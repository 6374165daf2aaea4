"""Merkle manifest of a dataset, grown by aligned appends that extend witnesses.

Leaves of a source lie in order, and every ``FAN`` consecutive nodes of a level form a run,
whose digest is a node of the next level. A leaf's witness is, level by level, the other
members of the runs it lies in.

* Appending. ``Subtrees`` takes nodes one by one. The nodes of an unfinished run make up an open
  subtree; all leaves below a node share what is missing from their witnesses, so a partial
  witness is attached to the subtree, not copied to its leaves. When a run is complete, each
  member's subtree gets the other members as its next piece, and the run's digest is appended one level up.
* Blocks. Positions are aligned to blocks of ``FAN ** LEVELS`` leaves. Blocks are grown side by side,
  each in one task; their roots are further appends, to the same kind of block one stage up, until a
  source has one node. Then the sources' roots are appended to a tree of their own.
* Witnesses go down again: every stage hands each child the path of its block plus the child's
  own pieces, so the last stage completes leaves without any join by leaf, and full witnesses
  are never stored.
* A manifest keeps its blocks in folders, one for each append. A later append reopens only the
  last, unfinished block of each source it adds to (fewer than ``FAN ** LEVELS`` leaves) and grows it on;
  complete blocks are never read for it. Repeating an append gives the same folder.

Each text is read once. After that rows hold an id and one or two digests. Positions come from a range
partitioning by (source, id, digest, row) with offsets for each part, so a source of any size
is ordered by many tasks. A task holds one block.

Null values count as ``-``; a null source is a source of its own, before all others; null ids come first
and are not tampered with. Texts of any length count whole. Equal ids are ordered by their leaves; equal
leaves are interchangeable. An empty table gives an empty result. Only the named columns are read. A source's
appends must come in the order of its leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type
from pyspark.sql.streaming import StreamingQuery

from ..conf import shared_dir
from .common import stored, table

FAN = 16
LEVELS = 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
GROUP = ["known", "source"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def record(columns: list[Column]) -> Column:
    """The digest of a row's values, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[encoded(c) for c in columns]), 256))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id", source: str = "source", text: str = "text", share: int = 5) -> DataFrame:
    """GROUP, doc_id, node and tampered (the node of a row whose text was altered, for every ``share``-th id)."""
    chosen = F.crc32(F.col(doc_id).cast("string")) % share == 0
    lowered = F.translate(F.col(text), _UPPER, _LOWER)
    altered = [lowered if f == text else F.col(f) for f in fields]
    return docs.select(
        F.col(source).isNotNull().alias("known"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.col(doc_id).alias("doc_id"),
        record([F.col(f) for f in fields]).alias("node"),
        F.when(chosen, record(altered)).alias("tampered"),
        F.monotonically_increasing_id().alias("row"),
    )


def placed(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with position, their 0-based number in their group. ``rows`` must be stored: they are read twice."""
    by = [*group, *order]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ordered = stored(ordered.withColumn("__seq", F.monotonically_increasing_id()), name)
    # the upper bits of the number are the part, the lower ones count its rows
    ordered = ordered.withColumns({"__part": F.shiftright("__seq", 33), "__at": F.col("__seq").bitwiseAND((1 << 33) - 1)})
    spans = ordered.groupBy(*group, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")
    spans = spans.select(*group, "__part", offset.alias("__offset"))
    joined = ordered.join(spans, [*group, "__part"])
    return joined.select(*rows.columns, (F.col("__at") + F.col("__offset")).alias("position"))


class Subtrees:
    """The open subtrees of one block while nodes are appended to it."""

    def __init__(self):
        self.open: list[list[str]] = [[]]
        #: pieces[level][k]: the members of the level's k-th run, which extend the witnesses of all below it
        self.pieces: list[list[list[str]]] = [[]]

    def append(self, node: str, level: int = 0) -> None:
        if level == len(self.open):
            self.open.append([])
            self.pieces.append([])
        self.open[level].append(node)
        if len(self.open[level]) == FAN:
            self.complete(level)

    def complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self.pieces[level].append(run)
        self.append(digest(*run), level + 1)

    def close(self, height: int | None) -> str:
        """The root: unfinished runs are completed up to ``height``, or until one node is left."""
        level = 0
        while level != height:
            nodes = len(self.pieces[level]) * FAN + len(self.open[level])
            if height is None and nodes == 1:
                break
            if self.open[level]:
                self.complete(level)
            level += 1
        return self.open[level][0]

    def witness(self, at: int) -> list[tuple[str, str]]:
        """What stands left and right of the node's ancestors, level by level."""
        found = []
        for runs in self.pieces:
            if at // FAN >= len(runs):
                break
            run, k = runs[at // FAN], at % FAN
            found.append(("".join(run[:k]), "".join(run[k + 1 :])))
            at //= FAN
        return found


def grown(nodes: list[bytes], first_block: bool) -> tuple[Subtrees, str]:
    """The subtrees of one block and its root. A source's only block ends with one node, others after LEVELS levels."""
    trees = Subtrees()
    for node in nodes:
        trees.append(node.hex())
    return trees, trees.close(None if first_block and len(nodes) < BLOCK else LEVELS)


def blocks(nodes: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """GROUP, block, n, nodes (all digests end to end), root, and the ``extra`` columns as arrays, from GROUP, position and node."""
    extra = extra or []
    fields = [nodes.schema[c] for c in GROUP]
    fields += [T.StructField("block", T.LongType()), T.StructField("n", T.IntegerType())]
    fields += [T.StructField("nodes", T.BinaryType()), T.StructField("root", T.BinaryType())]
    fields += [T.StructField(c, T.ArrayType(nodes.schema[c].dataType)) for c in extra]
    types = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in fields]

    def grow(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        known, source, block = (rows.column(c)[0].as_py() for c in (*GROUP, "__block"))
        held = rows.column("node").to_pylist()
        root = grown(held, block == 0)[1]
        made = [known, source, block, len(held), b"".join(held), bytes.fromhex(root)]
        made += [rows.column(c).to_pylist() for c in extra]
        return pa.table([pa.array([v], t) for v, t in zip(made, types, strict=True)], names=names)

    rows = nodes.withColumn("__block", F.expr(f"position div {BLOCK}"))
    return rows.groupBy(*GROUP, "__block").applyInArrow(grow, T.StructType(fields))


def stages(first: DataFrame, name: str) -> list[DataFrame]:
    """``first`` and the blocks of block roots above it, until no source has more than one."""
    found = [first]
    last = first.agg(F.max("block")).first()[0]
    while last:
        tall = found[-1].groupBy(*GROUP).agg(F.max("block").alias("__last")).where("__last > 0").select(*GROUP)
        roots = found[-1].select(*GROUP, F.col("block").alias("position"), F.col("root").alias("node"))
        found.append(stored(blocks(roots.join(tall, GROUP, "left_semi")), name))
        last //= BLOCK
    return found


def tops(levels: list[DataFrame]) -> DataFrame:
    """GROUP and node of every source: the root of its only block of some stage."""
    found = None
    for stage in levels:
        lone = stage.groupBy(*GROUP).agg(F.max("block").alias("__last"), F.min_by("root", "block").alias("node")).where("__last = 0").select(*GROUP, "node")
        found = lone if found is None else found.unionByName(lone)
    return found


PATH = T.ArrayType(T.StructType([T.StructField("left", T.BinaryType()), T.StructField("right", T.BinaryType())]))


def children(stage: DataFrame) -> DataFrame:
    """GROUP, position, path and subroot of every node of a stage; its blocks come with path and subroot."""
    schema = T.StructType([stage.schema[c] for c in GROUP] + [T.StructField("position", T.LongType()), T.StructField("path", PATH), T.StructField("subroot", T.BinaryType())])
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                nodes = [row["nodes"][i : i + 32] for i in range(0, len(row["nodes"]), 32)]
                trees, _ = grown(nodes, row["block"] == 0)
                n = len(nodes)
                paths = [[{"left": bytes.fromhex(a), "right": bytes.fromhex(z)} for a, z in trees.witness(k)] + row["path"] for k in range(n)]
                made = [[row["known"]] * n, [row["source"]] * n, [row["block"] * BLOCK + k for k in range(n)], paths, [row["subroot"]] * n]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, types, strict=True)], names=schema.fieldNames())

    return stage.select(*GROUP, "block", "nodes", "path", "subroot").mapInArrow(run, schema)


def folded(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a node and its witness lead to."""
    for left, right in path:
        node = digest(left, node, right)
    return node


def proofs(stage: DataFrame, root: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every leaf of the lowest stage."""
    arrow_id = to_arrow_type(stage.schema["doc_id"].dataType.elementType)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    types = [arrow_id, *[pa.string()] * 5, pa.bool_()]
    schema = T.StructType([T.StructField(c, from_arrow_type(t)) for c, t in zip(names, types, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                nodes = [row["nodes"][i : i + 32] for i in range(0, len(row["nodes"]), 32)]
                trees, _ = grown(nodes, row["block"] == 0)
                above = [(p["left"].hex(), p["right"].hex()) for p in row["path"]]
                tail = "".join(a + z for a, z in above)
                proof, reached = [], []
                for k, node in enumerate(nodes):
                    own = trees.witness(k)
                    proof.append(digest(*[a + z for a, z in own], tail))
                    claimed = row["tampered"][k] or node
                    reached.append(folded(folded(claimed.hex(), own), above))
                n = len(nodes)
                made = [row["doc_id"], [v.hex() for v in nodes], [row["subroot"].hex()] * n, [root] * n, proof, reached, [r == root for r in reached]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, types, strict=True)], names=names)

    return stage.select("block", "nodes", "doc_id", "tampered", "path", "subroot").mapInArrow(run, schema)


class Manifest:
    """A folder of blocks, one subfolder for each append."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, rows: DataFrame, number: int) -> None:
        """``leaves`` appended after those of all earlier numbers. Repeating an append replaces it."""
        rows = stored(rows, "merkle-leaves")
        new = placed(rows, GROUP, ["doc_id", "node", "row"], "merkle-placed").drop("row")
        if number > 0:
            before = self.blocks(before=number).select(*GROUP, "block", "n")
            ends = before.groupBy(*GROUP).agg(F.max(F.col("block") * BLOCK + F.col("n")).alias("__end"))
            new = new.join(ends, GROUP, "left").withColumn("position", F.col("position") + F.coalesce("__end", F.lit(0))).drop("__end")
            added_to = new.where("position >= 0").select(*GROUP).distinct()
            begun = self.blocks(before=number, closed=False).join(added_to, GROUP, "left_semi")
            part = F.posexplode(F.arrays_zip("doc_id", "tampered")).alias("__k", "__row")
            begun = begun.select(*GROUP, "block", "nodes", part)
            begun = begun.select(
                *GROUP,
                F.col("__row.doc_id").alias("doc_id"),
                F.substring("nodes", F.col("__k") * 32 + 1, F.lit(32)).alias("node"),
                F.col("__row.tampered").alias("tampered"),
                (F.col("block") * BLOCK + F.col("__k")).alias("position"),
            )
            new = begun.unionByName(new.select(*begun.columns))
        blocks(new, ["doc_id", "tampered"]).write.mode("overwrite").parquet(f"{self.path}/append={number}")

    def blocks(self, before: int | None = None, closed: bool | None = None) -> DataFrame:
        """The last state of every block; only those that are complete, or not, if ``closed`` is given.

        A complete block is never written again; only unfinished ones are compared by append.
        """
        rows = self.spark.read.option("basePath", self.path).parquet(self.path)
        if before is not None:
            rows = rows.where(F.col("append") < before)
        whole = rows.where(F.col("n") == BLOCK).drop("append")
        if closed:
            return whole
        key = [*GROUP, "block"]
        values = [c for c in whole.columns if c not in key]
        begun = rows.where(F.col("n") < BLOCK)
        begun = begun.groupBy(*key).agg(F.max_by(F.struct(*values), "append").alias("__last")).select(*key, "__last.*")
        begun = begun.join(whole.select(*key), key, "left_anti")
        return begun if closed is False else whole.unionByName(begun)

    def proofs(self) -> DataFrame:
        """Every leaf with its root, its witness' digest and the root that its claimed value leads to."""
        first = self.blocks()
        if first.limit(1).count() == 0:
            return proofs(first.withColumn("path", F.lit(None).cast(PATH)).withColumn("subroot", F.lit(None).cast("binary")), "")
        levels = stages(first, "merkle-stage")
        subroots = stored(tops(levels).withColumn("row", F.lit(0)).select(F.lit(False).alias("k"), F.lit("").alias("s"), *GROUP, "node"), "merkle-subroots")
        at = stored(placed(subroots, ["k", "s"], GROUP, "merkle-sources"), "merkle-sources-placed")
        over = at.select(F.col("k").alias("known"), F.col("s").alias("source"), "position", "node")
        upper = stages(stored(blocks(over), "merkle-tops"), "merkle-tops")
        root = tops(upper).first()["node"].hex()
        empty = F.array().cast(PATH)
        paths = descend(upper, lambda stage: stage.withColumn("path", empty).withColumn("subroot", F.col("root")))
        paths = children(paths).select("position", "path")
        own = at.join(paths, "position").select(*GROUP, "path", F.col("node").alias("subroot"))
        return proofs(descend(levels, lambda stage: stage.join(own, GROUP)), root)


def descend(levels: list[DataFrame], topped) -> DataFrame:
    """The lowest stage with path and subroot; ``topped`` gives them to the only block of a source, whatever its stage."""
    paths = None
    for stage in reversed(levels):
        lone = stage.groupBy(*GROUP).agg(F.max("block").alias("__last")).where("__last = 0").select(*GROUP)
        # at most one block for each source, so a source with many blocks doesn't meet in one task
        top = topped(stage.where("block = 0").join(lone, GROUP, "left_semi"))
        if paths is not None:
            below = paths.select(*GROUP, F.col("position").alias("block"), "path", "subroot")
            top = top.unionByName(stage.join(below, [*GROUP, "block"]).select(*top.columns))
        paths = children(top) if stage is not levels[0] else top
    return paths


def start_appends(rows: DataFrame, manifest: Manifest, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch of a stream of documents is one append."""

    def step(batch: DataFrame, number: int) -> None:
        manifest.append(leaves(batch), number)

    return (
        rows.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{manifest.path}/_checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = Manifest(spark, shared_dir(spark, "merkle"))
    manifest.append(leaves(table(spark, sf_dir, "documents")), 0)
    return manifest.proofs()


QUERIES = {"op11_merkle": (op11_merkle, None)}
