"""Streaming feedback: each micro-batch of callbacks is folded to one state for each post.

States are kept as a ``BatchTable``, so reading the labels costs a few runs of states, not the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.feedback import FOLD, as_log, fold_stretch, live_posts, merge_folds
from ..sources import schemas as S
from ..sources.batches import BatchTable


def fold_table(spark: SparkSession, path: str) -> BatchTable:
    return BatchTable(spark, f"{path}/folds", FOLD, merge=merge_folds)


def _unstored(states: DataFrame) -> DataFrame:
    return states.withColumn("stored_at", F.lit(None).cast("long"))


def start_feedback(
    log_stream: DataFrame, path: str, trigger: dict | None = None
) -> StreamingQuery:
    """Fold every micro-batch of log rows into ``path``; replaying one overwrites it. Rows must land in ``seq`` order."""
    table = fold_table(log_stream.sparkSession, path)

    def step(batch: DataFrame, batch_id: int) -> None:
        table.tidy(batch_id)
        table.write(_unstored(fold_stretch(batch.select(*S.FEEDBACK.fieldNames()))), batch_id)

    return (
        log_stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{path}/_checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_labels(spark: SparkSession, path: str, posts: DataFrame | None = None) -> DataFrame:
    """Live posts and labels: stored posts (if given) followed by the log."""
    states = fold_table(spark, path).read()
    if posts is not None:
        states = states.unionByName(_unstored(fold_stretch(as_log(posts))).withColumn("batch", F.lit(-1).cast("long")))
    return live_posts(merge_folds(states))
