"""Incremental ingest: which listed posts are new, their metadata, and the feeds' next marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.formats import parse_epoch, seconds_between
from ..sources.schemas import FEED_KEYS, POLL_KEYS, POST_KEYS
from .skew import lookup_join, ordered_position

# --- fixed values -----------------------------------------------------------------
MAX_PAGES = 10
POLL_INTERVAL_MINUTES = 5
NEW_FEED_NOTIFICATIONS = 5
METADATA_CHUNK = 50
# ----------------------------------------------------------------------------------

_AT = F.struct  # (page, pos): place of a post in its poll


def parse_listing(listing: DataFrame) -> DataFrame:
    """Adds ``published`` as epoch seconds; NULL where the text is not a number."""
    return listing.withColumn("published", parse_epoch(F.col("published_time")))


def split_listing(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a usable time, and the quarantined rest."""
    parsed = parse_listing(listing)
    bad = F.col("published").isNull()
    return parsed.where(~bad), parsed.where(bad).drop("published")


def read_pages(listing: DataFrame, max_pages: int | None = None, stops: DataFrame | None = None) -> DataFrame:
    """Per page of a poll: row count and time range, up to the last page, and to the page cap if one is given.

    A poll ends at its first page without ``has_more``; ``stops`` (POLL_KEYS, started_stop) has
    the last pages found in earlier runs.
    """
    capped = listing if max_pages is None else listing.where(F.col("page") < max_pages)
    pages = capped.groupBy(*POLL_KEYS, "page").agg(
        F.count(F.lit(1)).alias("page_rows"),
        F.max("published").alias("page_newest"),
        F.min("published").alias("page_oldest"),
        F.bool_and("has_more").alias("page_has_more"),
    )
    stop = F.min(F.when(~F.col("page_has_more"), F.col("page"))).over(Window.partitionBy(*POLL_KEYS))
    pages = pages.withColumn("stop_page", stop)
    if stops is not None:
        pages = pages.join(stops, POLL_KEYS, "left").withColumn("stop_page", F.least("stop_page", "started_stop")).drop("started_stop")
    return pages.where(
        F.col("stop_page").isNull() | (F.col("page") <= F.col("stop_page"))
    )


def _steps(listing: DataFrame, pages: DataFrame) -> DataFrame:
    """Per poll, how far it reads from any mark, as a staircase: POLL_KEYS, steps (low, best).

    A poll that stops at its first old post stops at the first row not above the mark. Only
    rows below all rows before them can be that one; ``best`` is the highest time before such a
    row, and rows with the same ``best`` make up one step, of which the lowest counts. From a
    mark m the poll ends in the first step with low <= m. Rows are reduced page by page first.
    """
    before = Window.partitionBy(*POLL_KEYS, "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = listing.select(*POLL_KEYS, "page", "pos", "published")
    rows = rows.withColumns({"_lowest": F.min("published").over(before), "_best": F.max("published").over(before)})
    falls = rows.where(F.col("_lowest").isNull() | (F.col("published") < F.col("_lowest")))
    falls = falls.groupBy(*POLL_KEYS, "page", "_best").agg(F.min("published").alias("low"))
    earlier = Window.partitionBy(*POLL_KEYS).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    tops = pages.select(
        *POLL_KEYS,
        "page",
        F.min("page_oldest").over(earlier).alias("_before_low"),
        F.max("page_newest").over(earlier).alias("_before_best"),
    )
    falls = falls.join(tops, [*POLL_KEYS, "page"]).where(F.col("_before_low").isNull() | (F.col("low") < F.col("_before_low")))
    steps = falls.groupBy(*POLL_KEYS, F.greatest("_best", "_before_best").alias("best")).agg(F.min("low").alias("low"))
    return steps.groupBy(*POLL_KEYS).agg(F.sort_array(F.collect_list(F.struct("low", "best")), asc=False).alias("steps"))


def _end_step(steps: Column, mark: Column) -> Column:
    """The step in which a poll ends that starts from ``mark``; NULL where it reads everything."""
    return F.get(F.filter(steps, lambda s: s["low"] <= mark), F.lit(0))


def _take_while_chain(polls: DataFrame) -> DataFrame:
    """``polls`` (POLL_KEYS, last_post_time, newest, steps, started_at, ended_before) with mark_before, mark_after and ended.

    Each poll is a function of the mark it starts from, and a feed's polls are applied in order. A
    poll begun in an earlier run keeps the mark it started from, and reads no further if it ended there.
    """
    polled = F.struct("poll_id", "newest", "steps", "started_at", "ended_before")
    feed = polls.groupBy(*FEED_KEYS).agg(F.min("last_post_time").alias("_mark"), F.sort_array(F.collect_list(polled)).alias("_polls"))

    def after(mark: Column, poll: Column) -> Column:
        start = F.coalesce(poll["started_at"], mark)
        end = _end_step(poll["steps"], start)
        read = F.when(end.isNull(), poll["newest"]).otherwise(end["best"])
        return F.when(poll["ended_before"], mark).otherwise(F.greatest(mark, read))

    def step(state: Column, poll: Column) -> Column:
        start = F.coalesce(poll["started_at"], state["mark"])
        mark = after(state["mark"], poll)
        ended = poll["ended_before"] | _end_step(poll["steps"], start).isNotNull()
        done = F.struct(poll["poll_id"].alias("poll_id"), start.alias("mark_before"), mark.alias("mark_after"), ended.alias("ended"))
        return F.struct(mark.alias("mark"), F.concat(state["done"], F.array(done)).alias("done"))

    none = F.array().cast("array<struct<poll_id:bigint,mark_before:bigint,mark_after:bigint,ended:boolean>>")
    chained = F.aggregate("_polls", F.struct(F.col("_mark").alias("mark"), none.alias("done")), step, lambda state: state["done"])
    marks = feed.select(*FEED_KEYS, F.explode(chained).alias("_m")).select(*FEED_KEYS, "_m.*")
    return polls.drop("steps", "started_at").join(marks, POLL_KEYS)


def poll_marks(
    listing: DataFrame,
    feeds: DataFrame,
    max_pages: int | None = None,
    polls: DataFrame | None = None,
    started: DataFrame | None = None,
    closed: DataFrame | None = None,
    prefix: bool = False,
) -> DataFrame:
    """One row per poll of a followed feed: the mark before and after it, and how far it read.

    The mark only grows from poll to poll, so over several polls of one feed it is a
    running maximum. Everything is reduced to pages first, then to polls; the running
    maximum runs over polls, not over posts. With ``prefix`` a poll stops at its first old
    post, and only rows before it raise the mark, for any number of polls and any order of rows.

    ``polls`` (POLL_KEYS) names all polls made, also those that list nothing. ``started``
    (POLL_KEYS, started_at, started_first, started_new, started_stop, ended) has the marks, flags and
    last pages of polls whose first rows came in an earlier run; their other rows are judged by
    them. ``closed`` (FEED_KEYS, floor): polls below the floor are left out.
    """
    stops = None if started is None else started.select(*POLL_KEYS, "started_stop")
    pages = read_pages(listing, max_pages, stops)
    listed = (
        pages.groupBy(*POLL_KEYS)
        .agg(
            F.sum("page_rows").alias("poll_rows"),
            F.max("page_newest").alias("newest"),
            F.min("page_oldest").alias("oldest"),
            F.max("page").alias("last_page"),
            F.max("stop_page").alias("stop_page"),
        )
    )
    if closed is not None:
        listed = listed.join(closed, FEED_KEYS, "left").where("floor IS NULL OR poll_id >= floor").drop("floor")
    order = Window.partitionBy(*FEED_KEYS).orderBy("poll_id")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    mark = F.greatest("last_post_time", F.max("newest").over(earlier))
    if polls is not None:
        listed = polls.select(*POLL_KEYS).distinct().join(listed, POLL_KEYS, "left").fillna(0, ["poll_rows"])
    marked = listed.join(feeds.select(*FEED_KEYS, "last_post_time", "new_feed"), FEED_KEYS).withColumn("first_poll", F.row_number().over(order) == 1)
    if started is not None:
        marked = (
            marked.join(started, POLL_KEYS, "left")
            .withColumn("first_poll", F.coalesce("started_first", "first_poll"))
            .withColumn("new_feed", F.coalesce("started_new", "new_feed"))
            .drop("started_first", "started_new", "started_stop")
        )
    else:
        marked = marked.withColumn("started_at", F.lit(None).cast("long")).withColumn("ended", F.lit(False))
    marked = marked.withColumn("ended_before", F.coalesce("ended", F.lit(False))).drop("ended")
    if prefix:
        marked = _take_while_chain(marked.join(_steps(listing, pages), POLL_KEYS, "left"))
    else:
        marked = marked.withColumn("mark_before", F.coalesce("started_at", mark)).drop("started_at")
        marked = marked.withColumn("mark_after", F.greatest("last_post_time", "mark_before", "newest")).withColumn("ended", F.lit(False))
    cut = (
        F.lit(False)
        if max_pages is None
        else F.col("stop_page").isNull()
        & (F.col("last_page") == max_pages - 1)
        & (F.col("oldest") > F.col("mark_before"))
    )
    return marked.withColumn("truncated", cut)


def new_posts(
    listing: DataFrame,
    marks: DataFrame,
    max_pages: int | None = None,
    prefix: bool = False,
) -> DataFrame:
    """Listing rows newer than the mark their poll started from.

    With ``prefix`` a poll stops at its first old post, also when newer ones follow; over
    several polls of one feed it needs ``marks`` made with ``prefix``. The two agree when listings are
    newest first.
    """
    capped = listing if max_pages is None else listing.where(F.col("page") < max_pages)
    wanted = marks.select(*POLL_KEYS, "poll_rows", "stop_page", "mark_before", "new_feed", "first_poll", "ended_before")
    rows = lookup_join(
        capped, wanted, POLL_KEYS, spread_by=["post_id", "page", "pos"], rows_col="poll_rows"
    ).where(F.col("stop_page").isNull() | (F.col("page") <= F.col("stop_page")))
    fresh = F.col("published") > F.col("mark_before")
    if prefix:
        rows = rows.where(~F.col("ended_before"))
        first_old = (
            rows.where(~fresh)
            .groupBy(*POLL_KEYS)
            .agg(
                F.min(_AT("page", "pos")).alias("first_old"),
                F.max("poll_rows").alias("first_old_rows"),
            )
        )
        rows = lookup_join(
            rows,
            first_old,
            POLL_KEYS,
            spread_by=["post_id", "page", "pos"],
            rows_col="first_old_rows",
            how="left",
        ).where(F.col("first_old").isNull() | (_AT("page", "pos") < F.col("first_old")))
        return rows.drop("first_old", "first_old_rows", "ended_before")
    return rows.where(fresh).drop("ended_before")


def take_while_marks(listing: DataFrame, marks: DataFrame, max_pages: int | None = None) -> DataFrame:
    """``marks`` as they are when each poll stops at its first old post: only rows before it raise the mark."""
    accepted = new_posts(listing, marks, max_pages, prefix=True)
    newest = accepted.groupBy(*POLL_KEYS).agg(F.max("published").alias("_newest"))
    return (
        marks.join(newest, POLL_KEYS, "left")
        .withColumn("mark_after", F.greatest("mark_before", "_newest"))
        .drop("_newest")
    )


def metadata_chunks(new: DataFrame, size: int = METADATA_CHUNK) -> DataFrame:
    """Numbers the new ids of each poll in listing order and cuts them into requests."""
    numbered = ordered_position(new, POLL_KEYS, bucket=F.col("page"), order=[F.col("pos")])
    return numbered.withColumn("chunk", F.expr(f"(position - 1) div {size}"))


def one_per_poll(new: DataFrame) -> DataFrame:
    """A post listed twice in one poll counts once, at its first place with its last URL."""
    return new.groupBy(*POLL_KEYS, "post_id").agg(
        F.min(_AT("page", "pos")).alias("at"),
        F.max_by("url", _AT("page", "pos")).alias("url"),
        F.max(_AT("page", "pos")).alias("last_at"),
        F.max("published").alias("published"),
        F.max("poll_rows").alias("poll_rows"),
        F.bool_and(F.col("new_feed") & F.col("first_poll")).alias("first_of_new_feed"),
    )


def known_posts(new: DataFrame, metadata: DataFrame) -> DataFrame:
    """New posts that have metadata, once per poll, without the metadata's wide columns.

    Overrides, messages and duplicate checks need no text, so it is attached last, to
    the rows that are stored.
    """
    return one_per_poll(new).join(metadata.select(*POST_KEYS), POST_KEYS, "left_semi")


def attach_metadata(posts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Posts with their metadata, inner; ``metadata`` has one row per post.

    Both sides shuffle on the post's key; a post that many feeds list is split by the
    adaptive skew join.
    """
    return posts.join(metadata.drop("url", "notify", "published_time"), POST_KEYS)


def enrich(new: DataFrame, metadata: DataFrame) -> DataFrame:
    """New posts, once per poll, with their metadata; ids without metadata vanish."""
    return attach_metadata(one_per_poll(new), metadata)


def missing_metadata(new: DataFrame, metadata: DataFrame) -> DataFrame:
    return (
        new.select(*POST_KEYS).distinct().join(metadata.select(*POST_KEYS), POST_KEYS, "left_anti")
    )


def override_new_feeds(
    enriched: DataFrame, first: int = NEW_FEED_NOTIFICATIONS, given: DataFrame | None = None, rows_col: str | None = None
) -> DataFrame:
    """``set_notify`` for a feed's first poll: true for its first posts, false for the rest.

    Only the first ``first`` places of each such poll are ranked (the limit is applied
    before the shuffle); the last of them is then the cut for all rows. ``given`` (POLL_KEYS,
    post_id, at) has the first places given to the same polls in earlier runs; they count.
    ``rows_col`` names a column of ``enriched`` with the rows of the poll, which then needn't be counted.
    ``enriched`` is read more than once: written rows keep the plan short.
    """
    ranked = enriched.where("first_of_new_feed").select(*POLL_KEYS, "post_id", "at")
    place = F.row_number().over(Window.partitionBy(*POLL_KEYS).orderBy("at"))
    firsts = ranked.withColumn("_place", place).where(F.col("_place") <= first)
    if given is not None:
        polls = firsts.select(*POLL_KEYS).distinct()
        both = firsts.drop("_place").unionByName(given.join(polls, POLL_KEYS, "left_semi"))
        both = both.groupBy(*POLL_KEYS, "post_id").agg(F.min("at").alias("at"))
        firsts = both.withColumn("_place", place).where(F.col("_place") <= first)
    cuts = firsts.groupBy(*POLL_KEYS).agg(F.max("at").alias("cut"))
    if rows_col is not None:
        sizes = enriched.where("first_of_new_feed").groupBy(*POLL_KEYS).agg(F.max(rows_col).alias("_poll_rows"))
        cuts = cuts.join(sizes, POLL_KEYS)
    with_cut = lookup_join(
        enriched, cuts, POLL_KEYS, spread_by=["post_id"], rows_col=None if rows_col is None else "_poll_rows", how="left"
    )
    return with_cut.withColumn(
        "set_notify", F.when(F.col("cut").isNotNull(), F.col("at") <= F.col("cut"))
    ).drop("cut", "_poll_rows")


def first_writes(batch: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each post in a batch (partial aggregation, no sort per post)."""
    others = [c for c in batch.columns if c not in POST_KEYS]
    first = F.min_by(F.struct(*others), F.struct(*order)).alias("_first")
    return batch.groupBy(*POST_KEYS).agg(first).select(
        *POST_KEYS, *[F.col(f"_first.{c}") for c in others]
    )


def insert_if_absent(batch: DataFrame, posts: DataFrame, order: list[str]) -> DataFrame:
    """Rows of a batch to append: the first of each post, unless it is stored already.

    A post is known by site and id. The stored ids are first reduced to those in the batch. A batch small enough to be
    broadcast then leaves the stored table unshuffled.
    """
    first = first_writes(batch, order)
    stored = posts.select(*POST_KEYS).join(first.select(*POST_KEYS), POST_KEYS, "left_semi")
    return first.join(stored, POST_KEYS, "left_anti")


def advance_feeds(feeds: DataFrame, marks: DataFrame, polled_at: Column) -> DataFrame:
    """The feed table after a round of polls: mark, poll time and flag of the polled feeds."""
    last = marks.groupBy(*FEED_KEYS).agg(F.max("mark_after").alias("mark_after"), F.lit(True).alias("_polled"))
    polled = F.coalesce("_polled", F.lit(False))
    return feeds.join(last, FEED_KEYS, "left").select(
        *FEED_KEYS,
        F.when(polled, polled_at).otherwise(F.col("last_query_time")).alias("last_query_time"),
        F.greatest("last_post_time", "mark_after").alias("last_post_time"),
        (F.col("new_feed") & ~polled).alias("new_feed"),
    )


def due_feeds(
    feeds: DataFrame, now: Column, interval_minutes: int = POLL_INTERVAL_MINUTES
) -> DataFrame:
    """Feeds whose last poll is long enough ago, new feeds first, then longest waiting."""
    waited = seconds_between(now, F.col("last_query_time"))
    return (
        feeds.withColumn("seconds_since", waited)
        .where(F.col("last_query_time").isNull() | (F.col("seconds_since") >= interval_minutes * 60))
        .orderBy(F.desc("new_feed"), F.asc_nulls_first("last_query_time"), *FEED_KEYS)
    )


def download_posts(requests: DataFrame, metadata: DataFrame) -> DataFrame:
    """Requested ids with metadata and URL; ``error`` where an id does not exist."""
    found = F.col("_found").isNotNull()
    return (
        requests.join(metadata.withColumn("_found", F.lit(True)), POST_KEYS, "left")
        .withColumn("error", F.when(~found, "post not found"))
        .drop("_found")
    )
