"""Queries over feeds and listings: polling, enrichment, storing, follow requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ..conf import shared_dir
from ..functions import formats
from ..operators import ingest as I
from ..operators import sites as SITE
from ..sources import derived, tables
from ..sources.schemas import FEED, FEEDBACK, LISTING, LISTING_REPLY, POLL_KEYS, POST_KEYS
from ..streaming.ingest import PostStore, first_listed, service_stream, start_ingest
from ..streaming.tick import TICK, Polling, polling_stream, start_polling
from . import base_sql as B

_PLACE = ["feed_type", "query", "poll_id", "page", "pos", "post_id"]


def _clock():
    return F.timestamp_seconds(F.lit(derived.CLOCK))


def _polled(spark, sf_dir, max_pages: int | None = None):
    listing, _ = I.split_listing(derived.listing(spark, sf_dir))
    marks = I.poll_marks(listing, derived.feeds(spark, sf_dir), max_pages)
    return listing, marks


def _accepted(spark, sf_dir) -> DataFrame:
    listing, marks = _polled(spark, sf_dir)
    return I.new_posts(listing, marks)


def _enriched(spark, sf_dir) -> DataFrame:
    return I.enrich(_accepted(spark, sf_dir), derived.posts(spark, sf_dir))


def poll_new_posts(spark, sf_dir) -> DataFrame:
    return _accepted(spark, sf_dir).select(*_PLACE, "published")


def poll_ids(spark, sf_dir) -> DataFrame:
    """New ids of each poll, numbered in listing order; rows, as a poll has no bound."""
    numbered = I.metadata_chunks(_accepted(spark, sf_dir))
    return numbered.select("feed_type", "query", "poll_id", "position", "post_id")


def poll_take_while(spark, sf_dir) -> DataFrame:
    listing, _ = I.split_listing(derived.unordered_listing(spark, sf_dir))
    marks = I.poll_marks(listing, derived.feeds(spark, sf_dir), max_pages=None)
    new = I.new_posts(listing, marks, max_pages=None, prefix=True)
    return new.select(*_PLACE, "published")


def poll_take_while_marks(spark, sf_dir) -> DataFrame:
    """The marks that polls of unordered listings leave when they stop at the first old post."""
    listing, _ = I.split_listing(derived.unordered_listing(spark, sf_dir))
    marks = I.poll_marks(listing, derived.feeds(spark, sf_dir))
    after = I.take_while_marks(listing, marks)
    return after.select("feed_type", "query", "poll_id", "mark_before", "mark_after")


def _take_while_rounds(spark, sf_dir):
    listing, _ = I.split_listing(derived.scattered_listing(spark, sf_dir))
    return listing, tables.written(I.poll_marks(listing, derived.feeds(spark, sf_dir), prefix=True), "marks")


def take_while_rounds(spark, sf_dir) -> DataFrame:
    """New posts of three unordered polls per feed, each read up to its first post not above the mark the one before left."""
    listing, marks = _take_while_rounds(spark, sf_dir)
    return I.new_posts(listing, marks, prefix=True).select(*_PLACE, "published")


def take_while_round_marks(spark, sf_dir) -> DataFrame:
    _, marks = _take_while_rounds(spark, sf_dir)
    return marks.select("feed_type", "query", "poll_id", "mark_before", "mark_after")


def poll_empty(spark, sf_dir) -> DataFrame:
    """The feed table after every feed was polled in every round, also where a poll lists nothing."""
    listing, _ = I.split_listing(derived.listing(spark, sf_dir))
    feeds = derived.feeds(spark, sf_dir)
    polls = feeds.select(*POLL_KEYS[:-1], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(derived.ROUNDS - 1).cast("long"))).alias("poll_id"))
    marks = I.poll_marks(listing, feeds, polls=polls)
    return _feed_rows(I.advance_feeds(feeds, marks, _clock()))


def poll_page_cap(spark, sf_dir) -> DataFrame:
    listing, _ = I.split_listing(derived.listing(spark, sf_dir))
    pages = I.read_pages(listing, I.MAX_PAGES)
    return pages.select("feed_type", "query", "poll_id", "page", "page_rows", "page_newest", "page_oldest")


def poll_truncated(spark, sf_dir) -> DataFrame:
    _, marks = _polled(spark, sf_dir, I.MAX_PAGES)
    return marks.select("feed_type", "query", "poll_id", "mark_before", "mark_after", "truncated")


def poll_mark_advance(spark, sf_dir) -> DataFrame:
    _, marks = _polled(spark, sf_dir)
    after = I.advance_feeds(derived.feeds(spark, sf_dir), marks, _clock())
    return _feed_rows(after)


def _feed_rows(feeds: DataFrame) -> DataFrame:
    return feeds.select(
        "feed_type",
        "query",
        F.unix_timestamp("last_query_time").alias("last_query_time"),
        "last_post_time",
        "new_feed",
    )


def metadata_batches(spark, sf_dir) -> DataFrame:
    """Request numbers at the upstream limit, and at 5 to see polls cut on this data."""
    chunks = I.metadata_chunks(_accepted(spark, sf_dir))
    return chunks.select(
        *_PLACE, "position", "chunk", F.expr("(position - 1) div 5").alias("chunk_of_5")
    )


def enrich_posts(spark, sf_dir) -> DataFrame:
    enriched = _enriched(spark, sf_dir)
    return enriched.select(
        "feed_type",
        "query",
        "poll_id",
        "post_id",
        "url",
        "title",
        F.col("author.username").alias("author"),
    )


def missing_metadata(spark, sf_dir) -> DataFrame:
    return I.missing_metadata(_accepted(spark, sf_dir), derived.posts(spark, sf_dir)).select("post_id")


def new_feed_override(spark, sf_dir) -> DataFrame:
    known = tables.written(I.known_posts(_accepted(spark, sf_dir), derived.posts(spark, sf_dir)), "known")
    overridden = I.override_new_feeds(known, rows_col="poll_rows")
    return overridden.select("feed_type", "query", "poll_id", "post_id", "set_notify")


def insert_if_absent(spark, sf_dir) -> DataFrame:
    """New posts of all polls against a store that already holds the labelled posts."""
    posts = derived.posts(spark, sf_dir)
    stored = posts.where(F.col("notify").isNotNull())
    known = tables.written(I.known_posts(_accepted(spark, sf_dir), posts), "known")
    first = I.insert_if_absent(known, stored, ["poll_id", "feed_type", "query", "at"])
    inserted = I.attach_metadata(first, posts)
    return inserted.select("post_id", "url", "title", "published")


def feeds_due(spark, sf_dir) -> DataFrame:
    due = I.due_feeds(derived.feeds(spark, sf_dir), _clock())
    return due.select("feed_type", "query", "new_feed", "seconds_since")


def _requests(spark, sf_dir) -> DataFrame:
    """One follow request per document: site argument by language, text by source."""
    documents = derived.table(spark, sf_dir, "documents")
    lang = F.col("lang")
    title = F.substring_index("text", "\n", 1)
    return documents.select(
        F.col("doc_id").alias("request_id"),
        F.when(lang == "en", "gallery")
        .when(lang == "fr", "Gallery")
        .when(lang == "de", "microblog")
        .when(F.col("source") == "src7", "Microblog")
        .otherwise(F.upper(lang))
        .alias("site_arg"),
        F.when(F.col("n_chars") % 3 == 0, "Tag")
        .when(F.col("n_chars") % 3 == 1, "User")
        .otherwise("tag")
        .alias("kind"),
        F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("@"), F.upper("source"), lang))
        .when(F.col("source") == "src1", "")
        .otherwise(title)
        .alias("text"),
    )


_REQUESTS = """
requests AS (
  SELECT doc_id AS request_id,
         CASE WHEN lang = 'en' THEN 'gallery' WHEN lang = 'fr' THEN 'Gallery' WHEN lang = 'de' THEN 'microblog'
              WHEN source = 'src7' THEN 'Microblog' ELSE upper(lang) END AS site_arg,
         CASE n_chars % 3 WHEN 0 THEN 'Tag' WHEN 1 THEN 'User' ELSE 'tag' END AS kind,
         CASE WHEN n_chars % 2 = 0 THEN '@' || upper(source) || lang WHEN source = 'src1' THEN ''
              ELSE split_part(text, chr(10), 1) END AS text
  FROM documents)"""

_FOLLOW = f"""
split_requests AS (
  SELECT *, regexp_extract_all(text, '[^\\s\\x0B\\x85\\p{{Z}}]+') AS words,
         CASE WHEN site_arg IN ('gallery', 'Gallery') THEN 'gallery'
              WHEN site_arg IN ('microblog', 'Microblog') THEN 'microblog' END AS site
  FROM requests),
follows AS (
  SELECT request_id, site, feed_type,
         CASE WHEN site IS NULL THEN NULL WHEN len(words) <> 1 THEN NULL
              WHEN site = 'microblog' THEN regexp_replace(lower(words[1]), '^@', '')
              ELSE lower(words[1]) END AS query,
         CASE WHEN site = 'microblog' THEN 0 ELSE {B.CLOCK} - 50000000 END AS last_post_time
  FROM (SELECT *, CASE WHEN site = 'microblog' THEN 'user' WHEN kind = 'Tag' THEN 'tag'
                       WHEN kind = 'User' THEN 'user' END AS feed_type FROM split_requests)),
checked AS (
  SELECT *, CASE WHEN site IS NULL THEN 'invalid site name' WHEN feed_type IS NULL THEN 'unknown follow type'
                 WHEN query IS NULL THEN 'query must be one word' END AS error FROM follows)"""


def _followed(spark, sf_dir) -> DataFrame:
    return SITE.follow_requests(_requests(spark, sf_dir), F.lit(derived.CLOCK))


def follow_requests(spark, sf_dir) -> DataFrame:
    return _followed(spark, sf_dir).select(
        "request_id",
        "site",
        "feed_type",
        "query",
        "last_post_time",
        "error",
        SITE.feed_endpoint(F.col("feed_type")).alias("endpoint"),
    )


def insert_feeds(spark, sf_dir) -> DataFrame:
    """The feed table after all accepted follow requests."""
    feeds = derived.feeds(spark, sf_dir)
    after = SITE.insert_feeds(feeds, SITE.new_feeds(_followed(spark, sf_dir)))
    return after.select(
        "site",
        "feed_type",
        "query",
        F.unix_timestamp("last_query_time").alias("last_query_time"),
        "last_post_time",
        "new_feed",
    )


def resolve_sites(spark, sf_dir) -> DataFrame:
    requests = _requests(spark, sf_dir)
    return requests.select("request_id", "site_arg", SITE.resolve_site(F.col("site_arg")).alias("site"))


def listing_requests(spark, sf_dir) -> DataFrame:
    """The request each feed's first page would need."""
    feeds = derived.feeds(spark, sf_dir)
    user, query = F.col("feed_type") == "user", F.col("query")
    params = formats.query_string(
        {
            "mature_content": F.lit("true"),
            "offset": F.lit("0"),
            "q": F.when(~user, query),
            "username": F.when(user, query),
        }
    )
    endpoint = SITE.feed_endpoint(F.col("feed_type"))
    return feeds.select(
        "feed_type", "query", F.concat_ws("?", endpoint, params).alias("request")
    )


def decode_replies(spark, sf_dir) -> DataFrame:
    """Listing pages as JSON reply bodies, decoded again."""
    listing = derived.listing(spark, sf_dir)
    post = F.struct(
        "pos", "published_time", F.col("post_id").alias("deviationid"), "url"
    )
    replies = (
        listing.groupBy(*POLL_KEYS, "page")
        .agg(F.sort_array(F.collect_list(post)).alias("results"), F.bool_and("has_more").alias("has_more"))
        .select(
            *POLL_KEYS,
            "page",
            F.to_json(
                F.struct("results", "has_more", ((F.col("page") + 1) * 2).alias("next_offset"))
            ).alias("body"),
        )
    )
    decoded = tables.decode_listing_reply(replies)
    return decoded.select(*_PLACE, "url", "published_time", "has_more", "next_offset")


def reply_quarantine(spark, sf_dir) -> DataFrame:
    """Reply bodies that can't be used: of every five pages one is whole, the others are cut, empty, partial or missing."""
    listing = derived.listing(spark, sf_dir)
    post = F.struct("published_time", F.col("post_id").alias("deviationid"), "url")
    pages = listing.groupBy(*POLL_KEYS, "page").agg(F.collect_list(post).alias("results"), F.bool_and("has_more").alias("has_more"))
    body = F.to_json(F.struct("results", "has_more"))
    kind = F.col("page") % 5
    body = F.when(kind == 0, body).when(kind == 1, F.expr("substr(to_json(struct(results, has_more)), 1, 25)")).when(kind == 2, " ").when(kind == 3, '{"has_more":true}')
    replies = pages.select(*POLL_KEYS, "page", body.alias("body"))
    return tables.broken_replies(replies, LISTING_REPLY, "results").select("feed_type", "query", "poll_id", "page", "reason")


def stream_poll_requests(spark, sf_dir) -> DataFrame:
    """What a clock of four ticks asks for, with follow requests that come between the first two."""
    base = shared_dir(spark, "polling")
    store = PostStore(spark, f"{base}/store")
    store.create(derived.feeds(spark, sf_dir))
    polling = Polling(store)
    for seconds in _TICKS:
        at = F.timestamp_seconds(F.lit(derived.CLOCK + seconds)).alias("tick")
        if seconds == _FOLLOWED_AT:
            SITE.new_feeds(_followed(spark, sf_dir)).select(at, *FEED.fieldNames()).write.mode("append").parquet(f"{base}/follows")
        else:
            spark.range(1).select(at).write.mode("append").parquet(f"{base}/ticks")
            spark.createDataFrame([], FEED).select(at, *FEED.fieldNames()).write.mode("append").parquet(f"{base}/follows")
        follows = spark.readStream.schema(StructType([*TICK.fields, *FEED.fields])).parquet(f"{base}/follows")
        stream = polling_stream(spark.readStream.schema(TICK).parquet(f"{base}/ticks"), follows)
        start_polling(polling, stream).awaitTermination()
    asked = polling.requests()
    return asked.select("site", "feed_type", "query", F.unix_timestamp("asked_at").alias("asked_at"), "woken")


_TICKS = (0, 60, 240, 360, 600)
_FOLLOWED_AT = 60


def _ticks_sql() -> str:
    """Feeds with the time they were last asked for, before and after each tick."""
    parts = ["asked_0 AS (SELECT site, feed_type, query, last_query_time AS last FROM feeds)"]
    for k, seconds in enumerate(_TICKS):
        now = B.CLOCK + seconds
        if seconds == _FOLLOWED_AT:
            parts.append(f"""made_{k} AS (
              SELECT DISTINCT site, feed_type, query, {now} AS asked_at, true AS woken FROM checked
              WHERE error IS NULL AND (site, feed_type, query) NOT IN (SELECT (site, feed_type, query) FROM asked_{k}))""")
        else:
            parts.append(f"""made_{k} AS (
              SELECT site, feed_type, query, {now} AS asked_at, false AS woken FROM asked_{k} WHERE last IS NULL OR {now} - last >= 300)""")
        parts.append(f"""asked_{k + 1} AS (
          SELECT site, feed_type, query, coalesce(m.asked_at, a.last) AS last
          FROM asked_{k} a FULL JOIN made_{k} m USING (site, feed_type, query))""")
    return ",".join(parts)


_STREAMS: dict[tuple[str, str], PostStore] = {}
#: Micro-batches at most: a log of many poll rounds lands several rounds at a time.
LANDINGS = 8


def _landings(rounds: list) -> list[list]:
    """Rounds in order, in ``LANDINGS`` groups at most."""
    n = min(len(rounds), LANDINGS)
    return [rounds[len(rounds) * k // n : len(rounds) * (k + 1) // n] for k in range(n)]


def _streamed(spark, sf_dir) -> PostStore:
    """Land the listing poll round by poll round, or a few rounds together, and run the stream after each landing.

    A micro-batch has a cost of its own, whatever its rows, so their number has a bound that doesn't grow with the
    time the log spans. How a round's rows lie in files, and which files make up a micro-batch, doesn't matter.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _STREAMS:
        return _STREAMS[key]
    base = shared_dir(spark, "ingest")
    store = PostStore(spark, f"{base}/store")
    store.create(derived.feeds(spark, sf_dir))
    metadata = derived.posts(spark, sf_dir)
    listing = derived.listing(spark, sf_dir)
    staged, landing = f"{base}/staged", f"{base}/landing"
    # One folder per round.
    listing.write.partitionBy("poll_id").parquet(staged)
    staged_rows = spark.read.schema(LISTING).parquet(staged)
    rounds = staged_rows.select("poll_id").distinct().orderBy("poll_id").collect()
    for landing_rounds in _landings([r["poll_id"] for r in rounds]):
        landed = staged_rows.where(F.col("poll_id").isin(landing_rounds))
        landed.select(*LISTING.fieldNames()).write.mode("append").parquet(landing)
        stream = tables.stream_listing(spark, landing, files_per_trigger=1_000_000)
        start_ingest(store, stream, metadata, polled_at=_clock).awaitTermination()
    _STREAMS[key] = store
    return store


def stream_ingest(spark, sf_dir) -> DataFrame:
    posts = _streamed(spark, sf_dir).posts()
    return posts.select("post_id", "url", "title", "published_time")


def stream_feeds(spark, sf_dir) -> DataFrame:
    store = _streamed(spark, sf_dir)
    return _feed_rows(store.feeds())


def stream_messages(spark, sf_dir) -> DataFrame:
    messages = _streamed(spark, sf_dir).messages()
    return messages.select("post_id", "set_notify", "skip_write", "url")


_SERVED: dict[tuple[str, str], PostStore] = {}


def _served(spark, sf_dir) -> PostStore:
    """Rounds of polls and thirds of the callbacks landed in turn, and run as one stream."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _SERVED:
        return _SERVED[key]
    base = shared_dir(spark, "service")
    store = PostStore(spark, f"{base}/store")
    store.create(derived.feeds(spark, sf_dir))
    metadata = derived.posts(spark, sf_dir)
    listing = tables.written(derived.listing(spark, sf_dir), "listing")
    feedback = derived.feedback(spark, sf_dir)
    n_events = derived.table(spark, sf_dir, "events").agg(F.max("event_id") + 1).first()[0]
    feedback = feedback.withColumn("part", F.expr(f"seq * {derived.ROUNDS} div {n_events}"))
    schemas = {"listing": LISTING, "feedback": FEEDBACK}
    for n in range(derived.ROUNDS):
        listing.where(F.col("poll_id") == n).write.mode("append").parquet(f"{base}/listing")
        feedback.where(F.col("part") == n).drop("part").write.mode("append").parquet(f"{base}/feedback")
        streams = [spark.readStream.schema(schema).parquet(f"{base}/{name}") for name, schema in schemas.items()]
        start_ingest(store, service_stream(*streams), metadata, polled_at=_clock).awaitTermination()
    _SERVED[key] = store
    return store


def stream_labels(spark, sf_dir) -> DataFrame:
    """The posts that live after polls and callbacks of three rounds, with their labels."""
    return _served(spark, sf_dir).posts().select("post_id", "url", "title", "published_time", "notify")


def stream_first_listed(spark, sf_dir) -> DataFrame:
    """The posts of a listing stream, each once, with state for posts of 60 days only."""
    base = shared_dir(spark, "listed")
    derived.listing(spark, sf_dir).write.parquet(f"{base}/landing")
    stream = tables.stream_listing(spark, f"{base}/landing", files_per_trigger=1_000_000)
    query = first_listed(stream, "60 days").select(*POST_KEYS).writeStream.format("parquet")
    query = query.option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("site string, post_id string").parquet(f"{base}/out")


_POLL = (B.FEEDS, B.LISTING, B.ACCEPTED)
_CAPPED = (B.FEEDS, B.LISTING, B.ACCEPTED_CAPPED)
_MARKS = """
SELECT feed_type, query, poll_id, any_value(mark_before) AS mark_before,
       greatest(any_value(mark_before), max(published)) AS mark_after,
       bool_and(stop_page IS NULL) AND max(page) = 9 AND min(published) > any_value(mark_before) AS truncated
FROM marked GROUP BY feed_type, query, poll_id"""
_FEEDS_AFTER = f"""
SELECT f.feed_type, f.query, CASE WHEN m.newest IS NULL THEN f.last_query_time ELSE {B.CLOCK} END AS last_query_time,
       greatest(f.last_post_time, coalesce(m.newest, f.last_post_time)) AS last_post_time,
       f.new_feed AND m.newest IS NULL AS new_feed
FROM feeds f LEFT JOIN (SELECT feed_type, query, max(published) AS newest FROM marked GROUP BY ALL) m
     USING (feed_type, query)"""
_FIRST_WRITE = """
firsts AS (
  SELECT e.*, a.published, row_number() OVER (PARTITION BY e.post_id
           ORDER BY e.poll_id, e.feed_type, e.query, e.place) AS nth
  FROM enriched e JOIN (SELECT feed_type, query, poll_id, post_id, max(published) AS published
                        FROM accepted GROUP BY ALL) a USING (feed_type, query, poll_id, post_id))"""
_PLACE_SQL = ", ".join(_PLACE)

QUERIES = {
    "poll_new_posts": (
        poll_new_posts,
        B.with_tables(f"SELECT {_PLACE_SQL}, published FROM accepted", *_POLL),
    ),
    "poll_ids": (
        poll_ids,
        B.with_tables(
            """SELECT feed_type, query, poll_id, post_id,
                 row_number() OVER (PARTITION BY feed_type, query, poll_id ORDER BY page, pos) AS position
            FROM accepted""",
            *_POLL,
        ),
    ),
    "poll_take_while": (
        poll_take_while,
        B.with_tables(
            f"""SELECT {_PLACE_SQL}, published FROM (
              SELECT u.*, max((u.published <= f.last_post_time)::INT) OVER (
                       PARTITION BY feed_type, query ORDER BY page, pos) AS seen_old
              FROM unordered u JOIN feeds f USING (feed_type, query)) WHERE seen_old = 0""",
            B.FEEDS,
            B.UNORDERED_LISTING,
        ),
    ),
    "poll_take_while_marks": (
        poll_take_while_marks,
        B.with_tables(
            """SELECT feed_type, query, poll_id, any_value(last_post_time) AS mark_before,
                 greatest(any_value(last_post_time), coalesce(max(published) FILTER (seen_old = 0), 0)) AS mark_after
            FROM (
              SELECT u.*, f.last_post_time, max((u.published <= f.last_post_time)::INT) OVER (
                       PARTITION BY feed_type, query ORDER BY page, pos) AS seen_old
              FROM unordered u JOIN feeds f USING (feed_type, query))
            GROUP BY feed_type, query, poll_id""",
            B.FEEDS,
            B.UNORDERED_LISTING,
        ),
    ),
    "take_while_rounds": (
        take_while_rounds,
        B.with_tables(
            " UNION ALL ".join(
                f"SELECT {_PLACE_SQL}, published FROM read_{k} WHERE stop IS NULL OR page * 1000000 + pos < stop" for k in range(3)
            ),
            B.FEEDS,
            B.SCATTERED_LISTING,
            B.TAKE_WHILE_ROUNDS,
        ),
    ),
    "take_while_round_marks": (
        take_while_round_marks,
        B.with_tables(
            " UNION ALL ".join(
                f"""SELECT DISTINCT feed_type, query, {k}::BIGINT AS poll_id, r.mark_before, m.mark AS mark_after
                FROM read_{k} r JOIN marks_{k + 1} m USING (feed_type, query)"""
                for k in range(3)
            ),
            B.FEEDS,
            B.SCATTERED_LISTING,
            B.TAKE_WHILE_ROUNDS,
        ),
    ),
    "stream_labels": (
        stream_labels,
        B.with_tables(
            "SELECT post_id, url, title, published_time, notify FROM live_3",
            *_POLL,
            B.POSTS,
            B.ENRICHED,
            B.FEEDBACK,
            B.THIRDS,
            B.SERVED,
        ),
    ),
    "stream_first_listed": (
        stream_first_listed,
        B.with_tables("SELECT DISTINCT site, post_id FROM listing", B.LISTING),
    ),
    "reply_quarantine": (
        reply_quarantine,
        B.with_tables(
            """SELECT DISTINCT feed_type, query, poll_id, page,
                 CASE page % 5 WHEN 1 THEN 'not parsed' WHEN 3 THEN 'no results' ELSE 'empty' END AS reason
            FROM listing WHERE page % 5 <> 0""",
            B.LISTING,
        ),
    ),
    "stream_poll_requests": (
        stream_poll_requests,
        B.with_tables(
            " UNION ALL ".join(f"SELECT * FROM made_{k}" for k in range(len(_TICKS))), B.FEEDS, _REQUESTS, _FOLLOW, _ticks_sql()
        ),
    ),
    "poll_empty": (
        poll_empty,
        B.with_tables(
            f"""SELECT feed_type, query, {B.CLOCK} AS last_query_time, false AS new_feed,
                 greatest(f.last_post_time, coalesce(max(l.published), f.last_post_time)) AS last_post_time
            FROM feeds f LEFT JOIN listing l USING (feed_type, query)
            GROUP BY feed_type, query, f.last_post_time""",
            B.FEEDS,
            B.LISTING,
        ),
    ),
    "poll_page_cap": (
        poll_page_cap,
        B.with_tables(
            """SELECT feed_type, query, poll_id, page, count(*) AS page_rows,
                 max(published) AS page_newest, min(published) AS page_oldest
            FROM read_rows GROUP BY ALL""",
            *_CAPPED,
        ),
    ),
    "poll_truncated": (poll_truncated, B.with_tables(_MARKS, *_CAPPED)),
    "poll_mark_advance": (poll_mark_advance, B.with_tables(_FEEDS_AFTER, *_POLL)),
    "metadata_batches": (
        metadata_batches,
        B.with_tables(
            f"""SELECT {_PLACE_SQL}, row_number() OVER w AS position, (row_number() OVER w - 1) // 50 AS chunk,
                 (row_number() OVER w - 1) // 5 AS chunk_of_5
            FROM accepted WINDOW w AS (PARTITION BY feed_type, query, poll_id ORDER BY page, pos)""",
            *_POLL,
        ),
    ),
    "enrich_posts": (
        enrich_posts,
        B.with_tables(
            "SELECT feed_type, query, poll_id, post_id, url, title, author FROM enriched",
            *_POLL,
            B.POSTS,
            B.ENRICHED,
        ),
    ),
    "missing_metadata": (
        missing_metadata,
        B.with_tables(
            "SELECT DISTINCT post_id FROM accepted WHERE post_id NOT IN (SELECT post_id FROM posts)",
            *_POLL,
            B.POSTS,
        ),
    ),
    "new_feed_override": (
        new_feed_override,
        B.with_tables(
            "SELECT feed_type, query, poll_id, post_id, set_notify FROM overridden",
            *_POLL,
            B.POSTS,
            B.ENRICHED,
            B.OVERRIDDEN,
        ),
    ),
    "insert_if_absent": (
        insert_if_absent,
        B.with_tables(
            """SELECT post_id, url, title, published FROM firsts
            WHERE nth = 1 AND post_id NOT IN (SELECT post_id FROM posts WHERE notify IS NOT NULL)""",
            *_POLL,
            B.POSTS,
            B.ENRICHED,
            _FIRST_WRITE,
        ),
    ),
    "feeds_due": (
        feeds_due,
        B.with_tables(
            f"""SELECT feed_type, query, new_feed, {B.CLOCK} - last_query_time AS seconds_since
            FROM feeds WHERE last_query_time IS NULL OR {B.CLOCK} - last_query_time >= 300""",
            B.FEEDS,
        ),
    ),
    "follow_requests": (
        follow_requests,
        B.with_tables(
            """SELECT request_id, site, feed_type, query, last_post_time, error,
                 CASE feed_type WHEN 'user' THEN 'gallery/all' WHEN 'tag' THEN 'browse/newest' END AS endpoint
            FROM checked""",
            _REQUESTS,
            _FOLLOW,
        ),
    ),
    "insert_feeds": (
        insert_feeds,
        B.with_tables(
            """SELECT site, feed_type, query, last_query_time, last_post_time, new_feed FROM feeds
            UNION ALL
            SELECT site, feed_type, query, NULL, min(last_post_time), true FROM checked
            WHERE error IS NULL
              AND (site, feed_type, query) NOT IN (SELECT (site, feed_type, query) FROM feeds)
            GROUP BY site, feed_type, query""",
            B.FEEDS,
            _REQUESTS,
            _FOLLOW,
        ),
    ),
    "resolve_sites": (
        resolve_sites,
        B.with_tables("SELECT request_id, site_arg, site FROM split_requests", _REQUESTS, _FOLLOW),
    ),
    "listing_requests": (
        listing_requests,
        B.with_tables(
            """SELECT feed_type, query,
                 CASE feed_type WHEN 'user' THEN 'gallery/all?mature_content=true&offset=0&username=' || url_encode(query)
                      ELSE 'browse/newest?mature_content=true&offset=0&q=' || url_encode(query) END AS request
            FROM feeds""",
            B.FEEDS,
        ),
    ),
    "decode_replies": (
        decode_replies,
        B.with_tables(
            f"SELECT {_PLACE_SQL}, url, published_time, has_more, (page + 1) * 2 AS next_offset FROM listing",
            B.LISTING,
        ),
    ),
    "stream_ingest": (
        stream_ingest,
        B.with_tables(
            "SELECT post_id, url, title, published AS published_time FROM firsts WHERE nth = 1",
            *_POLL,
            B.POSTS,
            B.ENRICHED,
            _FIRST_WRITE,
        ),
    ),
    "stream_feeds": (stream_feeds, B.with_tables(_FEEDS_AFTER, *_POLL)),
    "stream_messages": (
        stream_messages,
        B.with_tables(
            "SELECT post_id, set_notify, false AS skip_write, url FROM overridden",
            *_POLL,
            B.POSTS,
            B.ENRICHED,
            B.OVERRIDDEN,
        ),
    ),
}
