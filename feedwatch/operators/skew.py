"""Joins and numbering that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..conf import hot_key_rows


#: Keys that are broadcast at most: every key with more than 1 / HOT_KEYS of all rows is among them.
HOT_KEYS = 10_000


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    rows_col: str | None = None,
    how: str = "inner",
    hashed: bool = False,
) -> DataFrame:
    """Join many ``rows`` to a ``lookup`` with one row per key.

    Of the keys with more than ``feedwatch.hotKeyRows`` rows, the ``HOT_KEYS`` largest are
    matched by broadcast, so its size is bounded whatever the data. All other keys go
    through an ordinary shuffle join, in which the rows of hot keys are spread by a hash
    of ``spread_by``; adaptive execution splits what is left of skew there.

    ``rows_col`` names a column of ``lookup`` holding the number of rows per key. Without
    it the rows are counted here (map-side combined), and then keys that ``lookup``
    lacks are spread as well. With ``hashed`` the lookup's share of a task is held in a hash
    table, so the rows are not sorted: for lookups that are much smaller than the rows.
    """
    keys = list(keys)
    limit = hot_key_rows(rows.sparkSession)
    if rows_col is None:
        rows_col = "_rows"
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(rows_col))
        lookup = counts.join(lookup.withColumn("_known", F.lit(True)), keys, "left")
        keep_rows_col = False
    else:
        keep_rows_col = True
    if "_known" not in lookup.columns:
        lookup = lookup.withColumn("_known", F.lit(True))
    values = [c for c in lookup.columns if c not in keys]
    packed = lookup.select(*keys, F.struct(*values).alias("_v"))
    n = F.col(f"_v.{rows_col}")
    hot = packed.where(n > limit).orderBy(n.desc(), *keys).limit(HOT_KEYS).withColumnRenamed("_v", "_hot")
    # Hot keys stay in here too: their rows have another salt and never meet them.
    cold = packed.withColumn("_salt", F.lit(0).cast("bigint"))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*spread_by), F.lit(1 << 30)) + 1).otherwise(
        F.lit(0).cast("bigint")
    )
    joined = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", salt)
        .join(cold.hint("shuffle_hash") if hashed else cold, [*keys, "_salt"], "left")
        .withColumn("_v", F.coalesce("_hot", "_v"))
    )
    if how == "inner":
        joined = joined.where("_v._known")
    out = [v for v in values if v != "_known" and (keep_rows_col or v != rows_col)]
    return joined.select(*[F.col(c) for c in rows.columns], *[F.col(f"_v.{v}") for v in out])


def ordered_position(
    rows: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    position: str = "position",
    total: str = "group_rows",
) -> DataFrame:
    """1-based position of each row within its keys, and the size of the group.

    The order is (bucket ascending, ``order``). Only the rows of one (keys, bucket)
    are sorted together; the buckets before it enter as an offset, so a group of any
    size is numbered by many tasks. Choose the bucket so that one holds few rows.
    """
    keys = list(keys)
    with_bucket = rows.withColumn("_bucket", bucket)
    sizes = with_bucket.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(total),
    )
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        with_bucket.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(position, F.col("_offset") + F.col("_local"))
        .select(*rows.columns, position, total)
    )
