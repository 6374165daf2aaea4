"""Streaming notifier: messages with scores to an append-only notification table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import routing
from ..operators.sites import SiteModel
from ..sources.tables import write_batch


def stream_messages(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100
) -> DataFrame:
    return (
        spark.readStream.format("parquet")
        .schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )


def start_router(
    messages: DataFrame,
    scores: DataFrame,
    out: str,
    checkpoint: str,
    threshold: float = routing.NOTIFICATION_THRESHOLD,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Suppressed messages leave before the score is looked up; a post without score counts as failed."""
    pending = routing.to_classify(messages)
    scored = pending.join(scores.select("site", "post_id", "score"), ["site", "post_id"], "left")
    return start_notifier(scored, out, checkpoint, threshold, trigger)


def start_notifier(
    messages: DataFrame,
    out: str,
    checkpoint: str,
    threshold: float = routing.NOTIFICATION_THRESHOLD,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Scored messages routed to an append-only table; after a replay each is there once."""
    return (
        routing.route(messages, threshold)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def merged_stream(ingested: DataFrame, label_requests: DataFrame, added: DataFrame) -> DataFrame:
    """The three sources of messages as one stream; columns a source lacks are NULL."""
    return routing.merge_messages(ingested, label_requests, added)


def start_classifier(
    posts: DataFrame,
    model: SiteModel,
    out: str,
    checkpoint: str,
    threshold: float = routing.NOTIFICATION_THRESHOLD,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Posts as a stream (with set_notify and skip_write) scored by a fitted model and routed.

    The stages of a vector model run in the stream's own plan: no table of scores is read or joined. A model kept as a
    table scores each micro-batch, and ``out/batch=n`` has what micro-batch n sent.
    """
    kept = ["site", "post_id", "url", "set_notify", "skip_write", "score", "classify_error"]

    def routed(some: DataFrame) -> DataFrame:
        return routing.route(model.score(routing.to_classify(some)), threshold).select(*kept)

    if getattr(model, "table", None) is not None:
        stream = posts.writeStream.foreachBatch(lambda batch, batch_id: write_batch(routed(batch), out, batch_id))
        return stream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    return (
        routed(posts)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
