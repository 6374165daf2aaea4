"""User feedback folded into the current state of the posts.

What a stretch of the log does to a post is a small state (``FOLD``), whatever came before it:

``deleted``     there is a delete in it, so nothing earlier counts
``inserted``    there is an insert after the last delete
``label_any``   the last label after the last delete: counts if the post lived at the start
``label_live``  the same if the post had been inserted by then: counts if it did not

States of consecutive stretches merge into that of the whole, so a log can be cut anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..sources.schemas import POST_KEYS
from .skew import lookup_join

FOLD = T.StructType(
    [T.StructField(c, T.StringType()) for c in POST_KEYS]
    + [T.StructField(c, T.BooleanType()) for c in ("deleted", "inserted", "label_any", "label_live")]
    + [T.StructField("stored_at", T.LongType())]
)
_STATE = [f for f in FOLD.fieldNames() if f not in POST_KEYS]


def feedback_log(callbacks: DataFrame) -> DataFrame:
    """Parsed callbacks (button, site, post_id, seq) as log rows; display-only buttons drop out."""
    return callbacks.where(F.col("button").isin("cb_true", "cb_false", "cb_delete")).select(
        "seq", F.col("button").alias("op"), *POST_KEYS
    )


def as_log(posts: DataFrame) -> DataFrame:
    """Stored posts as the oldest log rows: an insert each, then the label if there is one."""
    inserts = posts.select(F.lit(-2).cast("bigint").alias("seq"), F.lit("insert").alias("op"), *POST_KEYS)
    labels = posts.where(F.col("notify").isNotNull()).select(
        F.lit(-1).cast("bigint").alias("seq"),
        F.when(F.col("notify"), "cb_true").otherwise("cb_false").alias("op"),
        *POST_KEYS,
    )
    return inserts.unionByName(labels)


def fold_stretch(log: DataFrame) -> DataFrame:
    """The state (POST_KEYS, deleted, inserted, label_any, label_live) of each post in a stretch of the log.

    Only the last label can count. It met a post inserted in this stretch if some insert lies
    between the last delete and that label. One map-side combined aggregation settles this
    unless the last insert comes after the last label (a repeated insert, which changes
    nothing). Only the inserts of those posts are looked at a second time.
    """
    op = F.col("op")
    is_label = op.isin("cb_true", "cb_false")
    last = log.where(is_label | op.isin("cb_delete", "insert")).groupBy(*POST_KEYS).agg(
        F.max(F.when(op == "cb_delete", F.col("seq"))).alias("gone"),
        F.max(F.when(op == "insert", F.col("seq"))).alias("came"),
        F.max(F.when(is_label, F.col("seq"))).alias("labelled"),
        F.max_by(F.when(is_label, op == "cb_true"), F.when(is_label, F.col("seq"))).alias("label"),
    )
    never = F.lit(-(1 << 62))
    last = last.withColumn("deleted", F.col("gone").isNotNull()).withColumn("gone", F.coalesce("gone", never))
    labels = F.coalesce(F.col("labelled") > F.col("gone"), F.lit(False))
    inserted = F.coalesce(F.col("came") > F.col("gone"), F.lit(False))
    existed = (
        lookup_join(
            log.where(op == "insert"),
            last.where(labels & (F.col("came") > F.col("labelled"))).select(*POST_KEYS, "gone", "labelled"),
            POST_KEYS,
            spread_by=["seq"],
        )
        .where((F.col("seq") > F.col("gone")) & (F.col("seq") < F.col("labelled")))
        .select(*POST_KEYS)
        .distinct()
        .withColumn("existed", F.lit(True))
    )
    met = (inserted & (F.col("came") < F.col("labelled"))) | F.coalesce("existed", F.lit(False))
    return last.join(existed, POST_KEYS, "left").select(
        *POST_KEYS,
        "deleted",
        inserted.alias("inserted"),
        F.when(labels, F.col("label")).alias("label_any"),
        F.when(labels & met, F.col("label")).alias("label_live"),
    )


def _then(a: Column, b: Column) -> Column:
    """The state of two stretches, ``a`` right before ``b``."""
    whole = F.struct(
        a.deleted.alias("deleted"),
        (a.inserted | b.inserted).alias("inserted"),
        F.coalesce(b.label_any, a.label_any).alias("label_any"),
        F.when(a.inserted, F.coalesce(b.label_any, a.label_live)).when(b.inserted, b.label_live).alias("label_live"),
        F.when(a.inserted, a.stored_at).otherwise(b.stored_at).alias("stored_at"),
    )
    return F.when(b.deleted, b).otherwise(whole)


def merge_folds(rows: DataFrame) -> DataFrame:
    """One state for each post from those of consecutive batches, in the order of ``batch``.

    A post has one row for each run that is merged, so its list is short however long the log.
    """
    others = [c for c in rows.columns if c not in (*POST_KEYS, *_STATE, "batch")]
    ordered = F.sort_array(F.collect_list(F.struct("batch", F.struct(*_STATE).alias("state"))))
    listed = rows.groupBy(*POST_KEYS, *others).agg(ordered.alias("_runs"), F.max("batch").alias("batch"))
    first = F.get("_runs", F.lit(0))["state"]
    rest = F.slice("_runs", F.lit(2), F.size("_runs"))
    state = F.aggregate(rest, first, lambda done, run: _then(done, run["state"]))
    return listed.withColumn("_state", state).select(*POST_KEYS, *others, *[F.col(f"_state.{c}").alias(c) for c in _STATE], "batch")


def fold_feedback(log: DataFrame) -> DataFrame:
    """Live posts and their label after replaying inserts, labels and deletes in ``seq`` order."""
    return live_posts(fold_stretch(log))


def live_posts(states: DataFrame) -> DataFrame:
    """Live posts and their label from states of the whole log."""
    return states.where("inserted").select(*POST_KEYS, F.col("label_live").alias("notify"))


def apply_feedback(posts: DataFrame, log: DataFrame) -> DataFrame:
    """Stored posts after a log of labels and deletes (posts are inserted by ingest only).

    A label is the last one after which no delete follows; a label on a deleted or
    unknown post does nothing.
    """
    op = F.col("op")
    is_label = op.isin("cb_true", "cb_false")
    last = log.groupBy(*POST_KEYS).agg(
        F.max_by(F.when(is_label, op == "cb_true"), F.when(is_label, F.col("seq"))).alias("_label"),
        F.bool_or(op == "cb_delete").alias("_gone"),
    )
    return (
        posts.join(last, POST_KEYS, "left")
        .where(~F.coalesce("_gone", F.lit(False)))
        .withColumn("notify", F.coalesce("_label", "notify"))
        .drop("_label", "_gone")
    )
