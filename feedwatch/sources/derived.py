"""Posts, feeds, listings and feedback derived from the driver's tables.

``plans/base_sql.py`` states the same mapping as SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.rank import seeded_rank
from ..operators.skew import ordered_position
from . import schemas as S

CLOCK = 1_706_659_200  # 2024-01-31 00:00:00 UTC
PAGE_SIZE = 2
ROUNDS = 3  # of ten days each


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def epoch_seconds(df: DataFrame, column: str) -> Column:
    """Whole seconds since 1970 UTC, whatever the session time zone."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")
    return F.unix_seconds(column)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts: first line = title, the rest = description, labels = notify."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    line_end = F.instr("text", "\n")

    def tag(name: str) -> Column:
        return F.struct(
            F.col(name).alias("tag_name"),
            F.lit(False).alias("sponsored"),
            F.lit("").alias("sponsor"),
        )

    return documents.join(labels, "doc_id", "left").select(
        F.lit("gallery").alias("site"),
        F.col("doc_id").cast("string").alias("post_id"),
        F.struct(
            F.col("source").alias("userid"),
            F.concat_ws("/", "source", "lang").alias("username"),
            F.lit("regular").alias("user_type"),
        ).alias("author"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(line_end > 0, F.expr("substr(text, instr(text, '\n') + 1)"))
        .otherwise("")
        .alias("description"),
        F.lit("none").alias("license"),
        F.lit(True).alias("allows_comments"),
        F.array(tag("lang"), tag("source")).alias("tags"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_mature"),
        F.concat(F.lit("https://x.example/p/"), "doc_id").alias("url"),
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("notify"),
        F.lit(CLOCK).cast("bigint").alias("published_time"),
    )


def posts_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same posts on two sites, told apart by language (the first tag)."""
    english = F.get(F.col("tags.tag_name"), F.lit(0)) == "en"
    return posts(spark, sf_dir).withColumn(
        "site", F.when(english, "gallery").otherwise("microblog")
    )


def page_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as posts with an HTML description."""
    return table(spark, sf_dir, "pages").select(
        F.lit("gallery").alias("site"),
        F.col("page_id").cast("string").alias("post_id"),
        "url",
        F.col("url").alias("title"),
        F.col("html").alias("description"),
    )


def _feed_columns() -> list[Column]:
    return [
        F.lit("gallery").alias("site"),
        F.when(F.col("user_id") % 2 == 0, "user").otherwise("tag").alias("feed_type"),
        F.concat(F.lit("q"), "user_id").alias("query"),
    ]


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed per user of the event log; every tenth was never polled."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    is_new = F.col("user_id") % 10 == 0
    return users.select(
        *_feed_columns(),
        F.when(
            ~is_new, F.timestamp_seconds(F.lit(CLOCK) - F.pmod("user_id", F.lit(12)) * 60)
        ).alias("last_query_time"),
        F.when(is_new, F.lit(CLOCK - 50_000_000))
        .otherwise(F.lit(CLOCK - 30 * 86400) + F.pmod("user_id", F.lit(31)) * 86400)
        .cast("bigint")
        .alias("last_post_time"),
        is_new.alias("new_feed"),
    )


def _listed_events(spark: SparkSession, sf_dir: str, poll_id: Column) -> DataFrame:
    events = table(spark, sf_dir, "events")
    n_posts = table(spark, sf_dir, "documents").count()
    seconds = events.select("event_id", "user_id", epoch_seconds(events, "ts").alias("published"))
    return seconds.select(
        *_feed_columns(),
        poll_id.cast("bigint").alias("poll_id"),
        "published",
        "event_id",
        F.pmod("event_id", F.lit(n_posts * 6 // 5)).cast("string").alias("post_id"),
    )


def _paged(numbered: DataFrame) -> DataFrame:
    page = F.expr(f"(position - 1) div {PAGE_SIZE}")
    last_page = F.expr(f"(group_rows - 1) div {PAGE_SIZE}")
    return numbered.select(
        *S.POLL_KEYS,
        page.cast("int").alias("page"),
        ((F.col("position") - 1) % PAGE_SIZE).cast("int").alias("pos"),
        "post_id",
        F.concat(F.lit("https://x.example/"), "event_id").alias("url"),
        F.col("published").cast("string").alias("published_time"),
        (page < last_page).alias("has_more"),
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feed listings: three ten-day polls per feed, newest first."""
    rows = _listed_events(spark, sf_dir, F.expr("(published - 1704067200) div 86400 div 10"))
    numbered = ordered_position(
        rows,
        S.POLL_KEYS,
        bucket=-F.expr("published div 3600"),
        order=[F.desc("published"), F.desc("event_id")],
    )
    return _paged(numbered)


def unordered_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One poll per feed in md5 order, so that old posts come ahead of new ones."""
    rows = _listed_events(spark, sf_dir, F.lit(0)).withColumn(
        "_digest", F.md5(F.col("event_id").cast("string"))
    )
    numbered = ordered_position(
        rows, S.POLL_KEYS, bucket=F.substring("_digest", 1, 4), order=[F.col("_digest")]
    )
    return _paged(numbered)


def scattered_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three polls per feed over the same days, each in md5 order."""
    rows = _listed_events(spark, sf_dir, F.pmod("event_id", F.lit(ROUNDS))).withColumn(
        "_digest", F.md5(F.col("event_id").cast("string"))
    )
    numbered = ordered_position(
        rows, S.POLL_KEYS, bucket=F.substring("_digest", 1, 4), order=[F.col("_digest")]
    )
    return _paged(numbered)


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as button presses and inserts."""
    kinds = {
        "signup": "insert",
        "click": "cb_true",
        "error": "cb_false",
        "view": "cb_delete",
        "purchase": "cb_print",
    }
    mapping = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.try_element_at(mapping, F.col("event_type")).alias("op"),
        F.lit("gallery").alias("site"),
        F.col("user_id").cast("string").alias("post_id"),
    )


def scored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post with a stand-in probability from its seeded rank."""
    return posts(spark, sf_dir).withColumn(
        "score", (seeded_rank("post_id", "score") % 9973) / F.lit(9973.0)
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts on their way to the notifier: the label is the override, French posts are
    not written, and posts without a description failed to classify."""
    return scored_posts(spark, sf_dir).select(
        "site",
        "post_id",
        "url",
        F.col("notify").alias("set_notify"),
        (F.get(F.col("tags.tag_name"), F.lit(0)) == "fr").alias("skip_write"),
        F.when(F.col("description") != "", F.col("score")).alias("score"),
    )
