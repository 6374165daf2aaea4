"""Polling that runs by itself: ticks ask for the feeds that are due, a follow request wakes its feed at once.

The stream writes one folder of poll requests for each micro-batch (``requests/batch=n``); whatever fetches listings
works them off and lands the replies for the ingest. What a feed was last asked for is kept as a snapshot for
each batch, so a feed whose listing hasn't landed yet isn't asked for again before its interval ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest as I
from ..operators.sites import insert_feeds, unique_feeds
from ..sources import schemas as S
from ..sources.batches import Snapshots
from ..sources.tables import read_batches, write_batch
from .store import PostStore

TICK = T.StructType([T.StructField("tick", T.TimestampType())])
REQUEST = T.StructType(
    [f for f in S.FEED.fields if f.name in S.FEED_KEYS]
    + [T.StructField("poll_id", T.LongType()), T.StructField("asked_at", T.TimestampType()), T.StructField("woken", T.BooleanType())]
)


def tick_source(spark: SparkSession, seconds: int = 60) -> DataFrame:
    """The clock as a stream: one row in ``seconds`` seconds."""
    rows = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", seconds * 1000)
    return rows.load().select(F.current_timestamp().alias("tick"))


def polling_stream(ticks: DataFrame, follows: DataFrame) -> DataFrame:
    """Ticks (tick) and feeds to follow (tick, and the columns of a feed) as one stream."""
    feed = [F.lit(None).cast(f.dataType).alias(f.name) for f in S.FEED.fields]
    return ticks.select("tick", *feed).unionByName(follows.select("tick", *S.FEED.fieldNames()))


class Polling:
    """The poll requests of one store."""

    def __init__(self, store: PostStore):
        self.store = store
        self.asked = Snapshots(store.spark, f"{store.path}/asked", S.FEED)
        self.requests_path = f"{store.path}/requests"

    def requests(self) -> DataFrame:
        return read_batches(self.store.spark, self.requests_path, REQUEST)

    def step(self, batch: DataFrame, batch_id: int, interval_minutes: int = I.POLL_INTERVAL_MINUTES) -> None:
        """Requests of one micro-batch: feeds followed in it, and those due at its last tick.

        A replay reads the snapshot before its batch and overwrites its own folders.
        """
        self.asked.tidy(batch_id)
        feeds = self.store.feeds()
        if batch_id > 0:
            before = self.asked.read(batch_id - 1)
            feeds = _last_asked(feeds, before)
        follows = batch.where(F.col("query").isNotNull())
        added = unique_feeds(follows.select(*S.FEED.fieldNames()))
        added = added.join(feeds.select(*S.FEED_KEYS), S.FEED_KEYS, "left_anti")
        now = batch.agg(F.max("tick").alias("tick"), F.max(F.when(F.col("query").isNull(), F.col("tick"))).alias("due_at")).first()
        asked = added.select(*S.FEED_KEYS, F.lit(True).alias("woken"))
        if now["due_at"] is not None:
            due = I.due_feeds(feeds, F.lit(now["due_at"]), interval_minutes)
            asked = asked.unionByName(due.select(*S.FEED_KEYS, F.lit(False).alias("woken")))
        asked = asked.withColumns({"poll_id": F.lit(batch_id).cast("long"), "asked_at": F.lit(now["tick"]).cast("timestamp")})
        write_batch(asked.select(*REQUEST.fieldNames()), self.requests_path, batch_id)
        made = self.store.spark.read.schema(REQUEST).parquet(f"{self.requests_path}/batch={batch_id}")
        at = made.select(*S.FEED_KEYS, "asked_at")
        known = insert_feeds(feeds, added).join(at, S.FEED_KEYS, "left")
        known = known.withColumn("last_query_time", F.greatest("last_query_time", "asked_at"))
        self.asked.write(known, batch_id)


def _last_asked(feeds: DataFrame, before: DataFrame) -> DataFrame:
    """The store's feeds, and those followed but not stored yet, with the time they were last asked for or polled."""
    asked = before.select(*S.FEED_KEYS, F.col("last_query_time").alias("_asked"), F.col("last_post_time").alias("_post"), F.col("new_feed").alias("_new"))
    joined = feeds.join(asked, S.FEED_KEYS, "full")
    return joined.select(
        *S.FEED_KEYS,
        F.greatest("last_query_time", "_asked").alias("last_query_time"),
        F.coalesce("last_post_time", "_post").alias("last_post_time"),
        F.coalesce("new_feed", "_new").alias("new_feed"),
    )


def start_polling(polling: Polling, stream: DataFrame, interval_minutes: int = I.POLL_INTERVAL_MINUTES, trigger: dict | None = None) -> StreamingQuery:
    """Run a ``polling_stream``; by default once over what has landed. A service passes ``{"processingTime": "1 minute"}``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            polling.step(batch, batch_id, interval_minutes)
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{polling.store.path}/_polling_checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
