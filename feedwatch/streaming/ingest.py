"""Streaming ingest: landed listing files to posts, messages and feed marks.

State lives in tables of the store, not in the streaming engine: a watermark is one mark per
stream, but every feed has its own. Micro-batch *n* reads what *n - 1* left (feeds and open polls)
and overwrites its own folders, so a replay after a lost executor or driver gives the
same tables. What it reads doesn't grow with the number of batches before it.

The polls of a feed must land in order. A poll may lie in several files and micro-batches: an open
poll keeps the mark it started from, whether it is the first poll of a new feed, its last page
and the first places already given, and its later rows are judged by these. The newest
``OPEN_POLLS`` polls of a feed are open; rows of older ones are quarantined. The
message files hold what each micro-batch sent; where a poll's files don't land in listing order,
first places can be sent too often there. ``PostStore.messages`` takes each poll as a whole,
so it is the same however files land and fall into micro-batches.

Feedback and follow requests may come with the same stream (``service_stream``): a batch first stores posts,
then applies its feedback, so a deleted post can be stored again by a later batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from ..functions.formats import parse_epoch
from ..operators import ingest as I
from ..operators.sites import insert_feeds, unique_feeds
from ..sources import schemas as S
from ..sources.tables import write_batch
from .store import MESSAGE_LOG, STORED_POST, PostStore, closed_below, next_open_polls

WRITE_ORDER = ["poll_id", "feed_type", "query", "at"]


def ingest_batch(
    store: PostStore,
    listing: DataFrame,
    batch_id: int,
    metadata: DataFrame,
    polled_at: Column,
    max_pages: int | None = None,
    feedback: DataFrame | None = None,
    follows: DataFrame | None = None,
    prefix: bool = False,
) -> None:
    """One round of polls: everything the push path does up to the notifier.

    ``feedback`` (seq, op, POST_KEYS) is applied after the batch's posts are stored, ``follows`` (feeds) are
    followed from this batch on. ``prefix``: a poll stops at its first old post; its files must then land in listing order.
    """
    spark = store.spark
    store.tidy(batch_id)
    parsed = I.parse_listing(listing).persist(StorageLevel.MEMORY_AND_DISK)
    marks = None
    try:
        usable = parsed.where(F.col("published").isNotNull())
        feeds = store.feeds(batch_id - 1)
        if follows is not None:
            feeds = insert_feeds(feeds, unique_feeds(follows.select(*S.FEED.fieldNames())))
        opened = store.open_polls.read(batch_id - 1)
        closed = closed_below(opened)
        marks = I.poll_marks(usable, feeds, max_pages, started=opened.drop("given"), closed=closed, prefix=prefix)
        marks = marks.persist(StorageLevel.MEMORY_AND_DISK)
        new = I.new_posts(usable, marks, max_pages, prefix=prefix)
        # Read several times below: written once as thin rows, which also keeps the plans of what follows short.
        known = _written(I.known_posts(new, metadata), f"{store.work_path}/known")
        given = opened.where("size(given) > 0").select(*S.POLL_KEYS, F.explode("given").alias("g")).select(*S.POLL_KEYS, "g.post_id", "g.at")
        messages = I.override_new_feeds(known, given=given, rows_col="poll_rows").withColumn("skip_write", F.lit(False))
        write_batch(messages.select(*MESSAGE_LOG.fieldNames()), store.messages_path, batch_id)
        sent = spark.read.schema(MESSAGE_LOG).parquet(f"{store.messages_path}/batch={batch_id}")
        first = _written(store.absent(I.first_writes(known, WRITE_ORDER), batch_id), f"{store.work_path}/first")
        inserted = I.attach_metadata(first, metadata).withColumn("published_time", F.col("published"))
        store.stored.write(inserted.select(*STORED_POST.fieldNames()), batch_id)
        store.write_states(first, feedback, batch_id)
        late = parsed.join(closed, S.FEED_KEYS).where("poll_id < floor").select(*parsed.columns)
        late = late.where(F.col("published").isNotNull())
        write_batch(parsed.where(F.col("published").isNull()).unionByName(late), store.quarantine_path, batch_id)
        begun = marks.select(
            *S.POLL_KEYS,
            F.col("mark_before").alias("started_at"),
            F.col("first_poll").alias("started_first"),
            F.col("new_feed").alias("started_new"),
            F.col("stop_page").alias("started_stop"),
            "ended",
        )
        write_batch(begun.drop("ended"), store.polls_path, batch_id)
        firsts = sent.where("first_of_new_feed AND set_notify")
        store.open_polls.write(next_open_polls(opened, begun, firsts), batch_id)
        store.feed_table.write(I.advance_feeds(feeds, marks, polled_at), batch_id)
    finally:
        for cached in (parsed, marks):
            if cached is not None:
                cached.unpersist()


def _written(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def start_ingest(
    store: PostStore,
    listing_stream: DataFrame,
    metadata: DataFrame,
    polled_at: Callable[[], Column] = F.current_timestamp,
    max_pages: int | None = None,
    trigger: dict | None = None,
    prefix: bool = False,
) -> StreamingQuery:
    """Run the ingest on a listing stream, or a ``service_stream``; by default once over everything that has landed."""
    service = "kind" in listing_stream.columns

    def step(batch: DataFrame, batch_id: int) -> None:
        feedback = follows = None
        if service:
            feedback = batch.where("kind = 'feedback'").select(*S.FEEDBACK.fieldNames())
            follows = batch.where("kind = 'follow'").select(*S.FEED.fieldNames())
            batch = batch.where("kind = 'listing'").select(*S.LISTING.fieldNames())
        ingest_batch(store, batch, batch_id, metadata, polled_at(), max_pages, feedback, follows, prefix)

    return (
        listing_stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{store.path}/_checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def service_stream(listing: DataFrame, feedback: DataFrame | None = None, follows: DataFrame | None = None) -> DataFrame:
    """One stream of listed posts, callbacks and feeds to follow, told apart by ``kind``."""
    schemas = {"listing": (listing, S.LISTING), "feedback": (feedback, S.FEEDBACK), "follow": (follows, S.FEED)}
    names = {f.name: f.dataType for _, schema in schemas.values() for f in schema.fields}
    union = None
    for kind, (rows, schema) in schemas.items():
        if rows is not None:
            held = set(schema.fieldNames())
            columns = [F.col(c) if c in held else F.lit(None).cast(t).alias(c) for c, t in names.items()]
            part = rows.select(F.lit(kind).alias("kind"), *columns)
            union = part if union is None else union.unionByName(part)
    return union


def first_listed(listing_stream: DataFrame, horizon: str = "30 days") -> DataFrame:
    """Each post of a listing stream once, however many polls list it: the first row that arrives.

    The state holds the posts of the last ``horizon`` only. It is exact for posts that
    aren't listed again after more than that, by publishing time; later ones pass once more.
    """
    stamped = listing_stream.withColumn("listed_at", F.timestamp_seconds(parse_epoch(F.col("published_time"))))
    stamped = stamped.where(F.col("listed_at").isNotNull()).withWatermark("listed_at", horizon)
    return stamped.dropDuplicatesWithinWatermark(S.POST_KEYS)


def polling_trigger(minutes: int = I.POLL_INTERVAL_MINUTES) -> dict:
    """Trigger of the continuous service: one micro-batch per polling interval."""
    return {"processingTime": f"{minutes} minutes"}


__all__ = ["PostStore", "first_listed", "ingest_batch", "polling_trigger", "service_stream", "start_ingest"]
