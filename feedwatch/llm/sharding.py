"""Sharding as a minimax contiguous partition of atomic groups.

Rows with equal text are one group and stay together. Groups lie on a line, ordered by their
place (the first 60 bits of the text's MD5). The smallest capacity with which cutting
greedily needs no more than the given shards is found by binary search, and the line is cut
there.

1. Rows. One pass over the texts writes doc_id, place, size and checksum of each row; all
   later steps read those thin rows only.
2. Large groups. A group of at least an equal share of what is left gets a shard of its own,
   largest first: no cut can split it, and cut off, it doesn't raise the capacity of the rest.
   Such a group lies in a cell (below) of at least that size, so only these cells are grouped.
3. Capacity. The line is known by cells, ranges of places with their total size, summed
   on the cluster. Two greedy walks bound the true one: one steps to the cell border before the
   point where the capacity is used up, one to that point itself. Binary search over both gives the
   range in which the smallest capacity lies; only cells that a cut may fall into are
   divided further, and so on until the two walks agree and every cut falls on a border
   between groups. The answer is exact. The driver holds cells, never rows or groups: at most
   ``2 ** CELL_BITS`` more in each round.
4. Shards. The cuts are at most ``shards`` numbers, so a row's shard is an expression of its
   place: no join and no shuffle.
5. Slots. Rows of a shard are numbered by (bucket, doc_id, place). Equal rows are counted
   first and numbered as a run, and ``BUCKET_ROWS`` rows of all have one bucket,
   so neither a large group nor a repeated row is sorted in one task.

A null text has size ``OVERHEAD``, no checksum, and the place of the empty text. Texts of any length
count whole. Repeated rows are separate rows; rows alike in id and text are
interchangeable. Two texts that share 60 bits of MD5 count as one group, which only
keeps them together. An empty table gives an empty result. With fewer groups than shards, some
shards stay empty. Extra columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SHARDS = 40
OVERHEAD = 16
PLACE_BITS = 60
CELL_BITS = 15
BUCKET_ROWS = 10_000


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, place, size and text_crc32 of every row, and the hash its slot goes by."""
    binary = F.encode(F.col(text), "UTF-8")
    digest = F.md5(F.coalesce(binary, F.lit(b"")))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.conv(F.substring(digest, 1, PLACE_BITS // 4), 16, 10).cast("long").alias("place"),
        (F.coalesce(F.octet_length(binary), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(binary).alias("text_crc32"),
    ).withColumn("mixed", spread(F.col("doc_id"), F.col("place")))


def spread(doc_id: Column, place: Column) -> Column:
    """24 bits that tell rows of one group, and rows of one id, apart."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), place.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("long")


class Line:
    """What the driver knows of the ordered groups: cells (first place, last place, size), one after another."""

    def __init__(self, cells: list[tuple[int, int, int]]):
        self.cells = sorted(cells)
        self.ends = []
        total = 0
        for _, _, size in self.cells:
            total += size
            self.ends.append(total)
        self.total = total

    def greedy(self, capacity: int, shards: int, whole: bool) -> tuple[list[int], list[int]]:
        """Where each shard ends, and the cells in which a capacity was used up short of a border.

        ``whole``: a shard ends at the last border it reaches, so it may end too early;
        else inside a divisible cell it ends where the capacity does, so it may end too late.
        """
        at, stops, inside = 0, [], []
        for _ in range(shards):
            goal = at + capacity
            k = bisect_right(self.ends, goal)
            border = self.ends[k - 1] if k else 0
            if k < len(self.ends) and goal > border and self.divisible(k):
                inside.append(k)
                at = border if whole else goal
            else:
                at = border
            stops.append(at)
        return stops, inside

    def divisible(self, k: int) -> bool:
        return self.cells[k][0] < self.cells[k][1]

    def smallest(self, shards: int, whole: bool) -> int:
        """The smallest capacity with which ``shards`` greedy shards reach the end."""
        low, high = -(-self.total // shards) - 1, self.total
        while high - low > 1:
            middle = (low + high) // 2
            if self.greedy(middle, shards, whole)[0][-1] >= self.total:
                high = middle
            else:
                low = middle
        return high

    def open_cells(self, shards: int) -> tuple[int, list[int]]:
        """The smallest capacity as far as known, and the cells that must be divided to know more (none: exact).

        With more known, the ranges that cuts may fall into only shrink, so each of these cells
        comes from the last division.
        """
        least, most = self.smallest(shards, whole=False), self.smallest(shards, whole=True)
        early, short = self.greedy(least, shards, whole=True)
        if least == most and not short:
            return most, []
        late, _ = self.greedy(most, shards, whole=False)
        found = set()
        for first, last in zip([0, *early[:-1]], [0, *late[:-1]], strict=True):
            a, b = bisect_right(self.ends, first + least), bisect_right(self.ends, last + most)
            found.update(k for k in range(a, min(b + 1, len(self.cells))) if self.divisible(k))
        return most, sorted(found)


def prefix(bits: int) -> Column:
    return F.shiftright("place", PLACE_BITS - bits)


def summed(rows: DataFrame, bits: int) -> list[tuple[int, int, int]]:
    """First place, last place and size of each cell, the places with the same first ``bits`` (map-side combined)."""
    sums = rows.groupBy(prefix(bits).alias("cell")).agg(F.min("place").alias("first"), F.max("place").alias("last"), F.sum("size").alias("size"))
    return [(r["first"], r["last"], r["size"]) for r in sums.select("first", "last", "size").collect()]


def in_cells(rows: DataFrame, cells: list[tuple[int, int, int]], bits: int) -> DataFrame:
    return rows.where(prefix(bits).isin([first >> (PLACE_BITS - bits) for first, _, _ in cells]))


def giants(rows: DataFrame, line: Line, shards: int, bits: int) -> list[tuple[int, int]]:
    """(place, size) of the groups that get a shard of their own, largest first; at most ``shards`` - 1."""
    share = line.total / shards
    while True:
        cells = [c for c in line.cells if c[2] >= share]
        groups = in_cells(rows, cells, bits).groupBy("place").agg(F.sum("size").alias("size"))
        largest = groups.orderBy(F.desc("size"), "place").limit(shards).collect() if cells else []
        found, rest = [], line.total
        for place, size in largest:
            if len(found) == shards - 1 or size * (shards - len(found)) < rest:
                break
            found.append((place, size))
            rest -= size
        # without them the others' equal share is smaller: smaller groups may reach it
        left = rest / (shards - len(found))
        if left >= share:
            return found
        share = left


def capacity(rows: DataFrame, shards: int, cell_bits: int = CELL_BITS) -> tuple[list[tuple[int, int]], int, list[int]]:
    """Groups with a shard of their own, the smallest capacity of the other shards, and the first place of each but the first of these."""
    bits = cell_bits
    line = Line(summed(rows, bits))
    alone = giants(rows, line, shards, bits)
    if alone:
        rows = rows.where(~F.col("place").isin([p for p, _ in alone]))
        line = Line(summed(rows, bits))
    left = shards - len(alone)
    while True:
        most, divide = line.open_cells(left)
        if not divide:
            break
        chosen = [line.cells[k] for k in divide]
        # as many parts of each as the bound on cells allows, two at least
        more = max(1, ((1 << cell_bits) // len(divide)).bit_length() - 1)
        finer = min(bits + more, PLACE_BITS)
        others = set(divide)
        line = Line([c for k, c in enumerate(line.cells) if k not in others] + summed(in_cells(rows, chosen, bits), finer))
        bits = finer
    cuts = []
    for stop in line.greedy(most, left, whole=True)[0]:
        k = bisect_right(line.ends, stop)
        if k < len(line.cells):
            cuts.append(line.cells[k][0])
    return alone, most, cuts


def count_below(cuts: list[int]) -> Column:
    """How many of the ordered cuts are at or below the place."""
    return sum((F.when(F.col("place") >= c, 1).otherwise(0) for c in cuts), F.lit(0))


def shard_rows(rows: DataFrame, shards: int = SHARDS, cell_bits: int = CELL_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` of ``sized`` with shard and slot. ``rows`` is read several times: give a stored table."""
    alone, _, cuts = capacity(rows, shards, cell_bits)
    shard = count_below(cuts) + len(alone)
    for k, (place, _) in enumerate(alone):
        shard = F.when(F.col("place") == place, k).otherwise(shard)
    buckets = max(1, -(-rows.count() // bucket_rows))
    bucket = F.shiftright(F.col("mixed") * buckets, 24).cast("int")
    keys = ["shard", "bucket"]
    runs = rows.withColumn("shard", shard.cast("int")).withColumn("bucket", bucket)
    runs = runs.groupBy(*keys, "doc_id", "place", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    inner = Window.partitionBy(*keys).orderBy("doc_id", "place", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    counts = rows.select(shard.cast("int").alias("shard"), bucket.alias("bucket")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    first = F.col("offset") + F.col("before")
    slots = F.sequence(first, first + F.col("n") - 1)
    return runs.join(offsets, keys).select("doc_id", "size", "text_crc32", "shard", F.explode(slots).alias("slot"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(sized(table(spark, sf_dir, "documents")), "sharding")
    return shard_rows(rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op12_sharding": (op12_sharding, None)}
