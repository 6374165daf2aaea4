"""The post store of a running engine: posts, what feedback did to them, feeds and open polls.

Posts and their states are ``BatchTable``s, so the folders that a micro-batch reads don't grow with the
batches before it. Whether a post is stored is asked of the states in two steps: a
Bloom filter, kept as a table of 64-bit words, tells for almost all new posts that no state of
theirs can exist; for the others only the buckets they lie in are read and compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..operators import ingest as I
from ..operators.feedback import FOLD, fold_stretch, live_posts, merge_folds
from ..operators.sites import unique_feeds
from ..sources import schemas as S
from ..sources.batches import BatchTable, Snapshots
from ..sources.tables import read_batches, write_batch

BUCKETS = 16
#: Words of 64 bits in the Bloom filter of all buckets; best at a quarter of the posts to be stored. More posts make
#: it let more through to the exact comparison, and change no result.
FILTER_WORDS = 1 << 24
FILTER_BITS = 4
#: Polls of a feed that stay open for late rows; rows of older ones are quarantined.
OPEN_POLLS = 4

STORED_POST = T.StructType([f for f in S.POST.fields if f.name != "notify"])
PLACE = T.StructType([f for f in S.LISTING.fields if f.name in ("page", "pos")])
POLL = T.StructType([f for f in S.LISTING.fields if f.name in S.POLL_KEYS])
MESSAGE_LOG = T.StructType(
    S.MESSAGE.fields
    + [T.StructField("url", T.StringType())]
    + [f for f in POLL.fields if f.name != "site"]
    + [T.StructField("at", PLACE), T.StructField("last_at", PLACE), T.StructField("first_of_new_feed", T.BooleanType())]
)
STARTED = T.StructType(
    POLL.fields
    + [T.StructField("started_at", T.LongType()), T.StructField("started_first", T.BooleanType())]
    + [T.StructField("started_new", T.BooleanType()), T.StructField("started_stop", T.IntegerType())]
)
GIVEN = T.StructType([T.StructField("at", PLACE), T.StructField("post_id", T.StringType())])
#: ``ended``: in take-while mode, the poll has met an old post.
OPEN_POLL = T.StructType(STARTED.fields + [T.StructField("given", T.ArrayType(GIVEN)), T.StructField("ended", T.BooleanType())])
KEY_STATE = T.StructType(FOLD.fields + [T.StructField("bucket", T.IntegerType()), T.StructField("word", T.LongType()), T.StructField("mask", T.LongType())])
FILTER = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("word", T.LongType()), T.StructField("bits", T.LongType())])


def _merge_filter(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket", "word").agg(F.expr("bit_or(bits)").alias("bits"), F.max("batch").alias("batch"))


def key_columns(buckets: int = BUCKETS, words: int = FILTER_WORDS) -> dict[str, Column]:
    """Bucket of a post, its word in the Bloom filter, and the bits it sets there."""
    h = "xxhash64(site, post_id)"
    bits = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({h}, {6 * k + 30}) & 63 as int))" for k in range(FILTER_BITS))
    return {
        "bucket": F.pmod(F.xxhash64(*S.POST_KEYS), F.lit(buckets)).cast("int"),
        "word": F.pmod(F.xxhash64(F.lit("word"), *S.POST_KEYS), F.lit(words)),
        "mask": F.expr(bits),
    }


class PostStore:
    """Folders of one engine instance: posts, states, feeds, polls, messages and quarantined listing rows."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, words: int = FILTER_WORDS):
        self.spark, self.path, self.buckets, self.words = spark, path.rstrip("/"), buckets, words
        self.stored = BatchTable(spark, f"{self.path}/posts", STORED_POST)
        self.states = BatchTable(spark, f"{self.path}/states", KEY_STATE, merge=merge_folds, bucket="bucket")
        self.filter = BatchTable(spark, f"{self.path}/filter", FILTER, merge=_merge_filter)
        self.feed_table = Snapshots(spark, f"{self.path}/feeds", S.FEED)
        self.open_polls = Snapshots(spark, f"{self.path}/open_polls", OPEN_POLL)
        self.feeds_path = self.feed_table.path
        self.work_path = f"{self.path}/work"
        self.messages_path = f"{self.path}/messages"
        self.quarantine_path = f"{self.path}/quarantine"
        self.polls_path = f"{self.path}/polls"

    def create(self, feeds: DataFrame) -> None:
        """Empty tables and the first feed snapshot, as batch -1."""
        empty = self.spark.createDataFrame
        write_batch(empty([], MESSAGE_LOG), self.messages_path, -1)
        write_batch(empty([], STARTED), self.polls_path, -1)
        self.feed_table.write(unique_feeds(feeds), -1)
        self.open_polls.write(empty([], OPEN_POLL), -1)

    def tidy(self, before: int) -> None:
        """Housekeeping before a batch: earlier ones are committed. Messages stay as they are, since streams follow them."""
        for table in (self.stored, self.states, self.filter, self.feed_table, self.open_polls):
            table.tidy(before)

    def feeds(self, batch_id: int | None = None) -> DataFrame:
        return self.feed_table.read(self.feed_table.last() if batch_id is None else batch_id)

    def labels(self, before: int | None = None) -> DataFrame:
        """Live posts (POST_KEYS, notify)."""
        return live_posts(merge_folds(self.states.read(before)))

    def posts(self, before: int | None = None) -> DataFrame:
        """Live posts with their labels; of a post that was deleted and stored again, the last version."""
        states = merge_folds(self.states.read(before)).where("inserted")
        states = states.select(*S.POST_KEYS, F.col("stored_at").alias("batch"), F.col("label_live").alias("notify"))
        return self.stored.read(before).join(states, [*S.POST_KEYS, "batch"]).select(*S.POST.fieldNames())

    def with_keys(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns(key_columns(self.buckets, self.words))

    def absent(self, rows: DataFrame, before: int) -> DataFrame:
        """The rows (one for each post) whose post doesn't live in the store before a batch."""
        if not self.filter.runs(before):
            return rows
        known = self.filter.read(before)
        keys = self.with_keys(rows.select(*S.POST_KEYS))
        hits = keys.join(known.select("bucket", "word", "bits"), ["bucket", "word"]).where("bits & mask = mask")
        hits = hits.select(*S.POST_KEYS, "bucket").distinct()
        # one number for each bucket at most
        buckets = [r["bucket"] for r in hits.select("bucket").distinct().collect()]
        if not buckets:
            return rows
        states = self.states.read(before).where(F.col("bucket").isin(buckets))
        states = merge_folds(states.join(hits, [*S.POST_KEYS, "bucket"], "left_semi"))
        return rows.join(live_posts(states).select(*S.POST_KEYS), S.POST_KEYS, "left_anti")

    def write_states(self, inserted: DataFrame, feedback: DataFrame | None, batch_id: int) -> None:
        """What a batch did to posts: the inserts first, then the feedback that came with it."""
        if feedback is None:
            unlabelled = F.lit(None).cast("boolean")
            folded = inserted.select(
                *S.POST_KEYS, F.lit(False).alias("deleted"), F.lit(True).alias("inserted"), unlabelled.alias("label_any"), unlabelled.alias("label_live")
            )
        else:
            log = inserted.select(F.lit(-1).cast("long").alias("seq"), F.lit("insert").alias("op"), *S.POST_KEYS)
            presses = feedback.where("op IN ('cb_true', 'cb_false', 'cb_delete')")
            folded = fold_stretch(log.unionByName(presses.select("seq", "op", *S.POST_KEYS)))
        states = self.with_keys(folded.withColumn("stored_at", F.when(F.col("inserted"), F.lit(batch_id).cast("long"))))
        self.states.write(states, batch_id)
        written = self.states.read_runs([(batch_id, batch_id)])
        self.filter.write(written.groupBy("bucket", "word").agg(F.expr("bit_or(mask)").alias("bits")), batch_id)

    def messages(self) -> DataFrame:
        """One message for each post of a poll, judged by the whole poll."""
        log = read_batches(self.spark, self.messages_path, MESSAGE_LOG)
        polls = read_batches(self.spark, self.polls_path, STARTED)
        stops = polls.groupBy(*S.POLL_KEYS).agg(F.min("started_stop").alias("started_stop")).where("started_stop IS NOT NULL")
        read = log.join(stops, S.POLL_KEYS, "left").where("started_stop IS NULL OR at.page <= started_stop")
        merged = read.groupBy(*S.POLL_KEYS, "post_id").agg(
            F.min("at").alias("at"),
            F.max_by("url", "last_at").alias("url"),
            F.bool_and("skip_write").alias("skip_write"),
            F.bool_and("first_of_new_feed").alias("first_of_new_feed"),
        )
        return I.override_new_feeds(merged).select(*S.MESSAGE.fieldNames(), "url")


def closed_below(open_polls: DataFrame, keep: int = OPEN_POLLS) -> DataFrame:
    """FEED_KEYS and floor of the feeds that have their number of open polls: polls below the floor are closed."""
    counted = open_polls.groupBy(*S.FEED_KEYS).agg(F.count(F.lit(1)).alias("_n"), F.min("poll_id").alias("floor"))
    return counted.where(F.col("_n") >= keep).select(*S.FEED_KEYS, "floor")


def next_open_polls(before: DataFrame, begun: DataFrame, firsts: DataFrame, keep: int = OPEN_POLLS) -> DataFrame:
    """The open polls after a batch.

    ``begun`` (STARTED and ended) has the polls of this batch, ``firsts`` (POLL_KEYS, post_id, at)
    the first places given in it. What a poll started with is kept, the newest polls of each feed stay.
    """
    given = before.where("size(given) > 0").select(*S.POLL_KEYS, F.explode("given").alias("g"))
    given = given.select(*S.POLL_KEYS, "g.post_id", "g.at").unionByName(firsts.select(*S.POLL_KEYS, "post_id", "at"))
    given = given.groupBy(*S.POLL_KEYS, "post_id").agg(F.min("at").alias("at"))
    # a batch gives no more than the first places, so these lists are short
    listed = F.slice(F.sort_array(F.collect_list(F.struct("at", "post_id"))), 1, I.NEW_FEED_NOTIFICATIONS)
    given = given.groupBy(*S.POLL_KEYS).agg(listed.alias("given"))
    both = before.drop("given").withColumn("_new", F.lit(0)).unionByName(begun.withColumn("_new", F.lit(1)))
    one = both.groupBy(*S.POLL_KEYS).agg(
        *[F.min_by(c, "_new").alias(c) for c in ("started_at", "started_first", "started_new")],
        F.min("started_stop").alias("started_stop"),
        F.bool_or("ended").alias("ended"),
    )
    # as many as stay open for each feed: the limit is applied before the shuffle
    newest = F.row_number().over(Window.partitionBy(*S.FEED_KEYS).orderBy(F.desc("poll_id")))
    kept = one.withColumn("_nth", newest).where(F.col("_nth") <= keep).drop("_nth")
    return kept.join(given, S.POLL_KEYS, "left")
