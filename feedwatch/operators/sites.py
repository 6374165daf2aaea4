"""Site registry, site-name resolution and follow requests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import formats, text
from ..sources import schemas as S

_ONE_FIELD = 1


class SiteModel(Protocol):
    """A notification model of one site: sets in, sets out."""

    def score(self, posts: DataFrame) -> DataFrame: ...

    def statistics(self, posts: DataFrame) -> DataFrame: ...

    def select_to_label(self, posts: DataFrame, count: int) -> DataFrame: ...

    def retrain(self, posts: DataFrame) -> SiteModel: ...


@dataclass(frozen=True)
class SiteSpec:
    """What the engine needs to know about one kind of site. All else is the same for every site."""

    name: str
    pretty: str
    listing_schema: T.StructType  # of the landed listing files
    link: Callable[[Column, Column], Column]  # (post_id, url) -> link
    body: Callable[[Column, Column], Column]  # (title, description) -> readable text
    normalise_follow: Callable[[Column], Column]  # query -> normalised query or NULL
    feed_types: dict[str, str]  # what a user picks -> feed type; of a site with one type it doesn't matter
    first_mark: Callable[[Column], Column]  # time of the request -> mark that a new feed starts from
    as_listing: Callable[[DataFrame], DataFrame] = lambda landed: landed  # landed files -> S.LISTING
    train: Callable[[DataFrame, str], SiteModel] | None = None  # (posts, site) -> model; None: the engine's own

    def feed_type(self, kind: Column) -> Column:
        """Feed type of what the user picked; NULL for what the site doesn't offer."""
        types = sorted(set(self.feed_types.values()))
        if len(types) == 1:
            return F.lit(types[0])
        found = F.lit(None).cast("string")
        for picked, feed_type in self.feed_types.items():
            found = F.when(kind == picked, feed_type).otherwise(found)
        return found


def normalise_query(query: Column) -> Column:
    """The lower-cased query when it is exactly one white-space field, else NULL."""
    parts = formats.fields(query)
    return F.when(F.size(parts) == _ONE_FIELD, F.lower(F.get(parts, F.lit(0))))


def normalise_user(user: Column) -> Column:
    """Like ``normalise_query``, without one leading ``@``."""
    return F.regexp_replace(normalise_query(user), "^@", "")


def _post_body(title: Column, description: Column) -> Column:
    return formats.full_text(title, text.display_text(description))


SITES: dict[str, SiteSpec] = {}


def register(spec: SiteSpec) -> None:
    """Make a site known under its name and its pretty name, neither of which may be taken."""
    taken = {n for s in SITES.values() for n in (s.name, s.pretty)}
    if taken & {spec.name, spec.pretty}:
        raise ValueError(f"a site is registered as {spec.name} or {spec.pretty} already")
    SITES[spec.name] = spec


register(
    SiteSpec(
        "gallery",
        "Gallery",
        S.LISTING,
        link=lambda post_id, url: url,
        body=_post_body,
        normalise_follow=normalise_query,
        feed_types={"Tag": "tag", "User": "user"},
        first_mark=formats.history_start,
    )
)
register(
    SiteSpec(
        "microblog",
        "Microblog",
        S.LISTING,
        link=lambda post_id, url: formats.microblog_link(post_id),
        body=_post_body,
        normalise_follow=normalise_user,
        feed_types={"User": "user"},
        first_mark=lambda now: F.lit(0),
    )
)


def site_listing(spark: SparkSession, path: str, site: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Landed listing files of a site as rows of S.LISTING; a stream if ``files_per_trigger`` is given."""
    spec = SITES[site]
    reader = spark.read if files_per_trigger is None else spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    return spec.as_listing(reader.format(fmt).schema(spec.listing_schema).load(path)).select(*S.LISTING.fieldNames())


def site_link(site: Column, post_id: Column, url: Column) -> Column:
    """The link to a post; the stored URL where the site isn't known."""
    return per_site(site, lambda s: s.link(post_id, url), otherwise=url)


def site_body(site: Column, title: Column, description: Column) -> Column:
    return per_site(site, lambda s: s.body(title, description), otherwise=_post_body(title, description))


def resolve_site(site_arg: Column) -> Column:
    """Registered site for a machine or pretty name (exact, case-sensitive), else NULL.

    The registry is a handful of entries known when the plan is built, so it is an
    expression rather than a join.
    """
    found = F.lit(None).cast("string")
    for spec in SITES.values():
        found = F.when(site_arg.isin(spec.name, spec.pretty), F.lit(spec.name)).otherwise(found)
    return found


def per_site(site: Column, pick: Callable[[SiteSpec], Column], otherwise: Column | None = None) -> Column:
    """A column chosen by the row's site."""
    chosen = F.lit(None) if otherwise is None else otherwise
    for spec in SITES.values():
        chosen = F.when(site == spec.name, pick(spec)).otherwise(chosen)
    return chosen


def feed_endpoint(feed_type: Column) -> Column:
    """Listing endpoint of a feed type; NULL for a type that does not exist."""
    return F.when(feed_type == "user", "gallery/all").when(feed_type == "tag", "browse/newest")


def follow_requests(requests: DataFrame, now: Column) -> DataFrame:
    """Validate (site_arg, kind, text) requests: a feed to insert or the reason it is refused.

    ``kind`` is what the user picked (``Tag`` / ``User``); sites with one feed type ignore it.
    """
    site = resolve_site(F.col("site_arg"))
    plain = F.when(F.col("kind") == "Tag", "tag").when(F.col("kind") == "User", "user")
    kind = per_site(site, lambda s: s.feed_type(F.col("kind")), otherwise=plain)
    query = per_site(F.col("site"), lambda s: s.normalise_follow(F.col("text")))
    checked = requests.withColumn("site", site).withColumn("feed_type", kind)
    checked = checked.withColumn("query", query)
    return checked.withColumn(
        "error",
        F.when(F.col("site").isNull(), "invalid site name")
        .when(F.col("feed_type").isNull(), "unknown follow type")
        .when(F.col("query").isNull(), "query must be one word"),
    ).withColumn(
        "last_post_time",
        per_site(F.col("site"), lambda s: s.first_mark(now), otherwise=formats.history_start(now)).cast("bigint"),
    )


def new_feeds(requests: DataFrame) -> DataFrame:
    """Feeds to insert from accepted follow requests, one per key."""
    return unique_feeds(
        requests.where(F.col("error").isNull()).select(
            *S.FEED_KEYS,
            F.lit(None).cast("timestamp").alias("last_query_time"),
            "last_post_time",
            F.lit(True).alias("new_feed"),
        )
    )


def unique_feeds(feeds: DataFrame) -> DataFrame:
    """One feed per key; the lowest mark wins, so that no post is missed."""
    return feeds.groupBy(*S.FEED_KEYS).agg(
        F.min("last_query_time").alias("last_query_time"),
        F.min("last_post_time").alias("last_post_time"),
        F.bool_and("new_feed").alias("new_feed"),
    )


def insert_feeds(feeds: DataFrame, added: DataFrame) -> DataFrame:
    """The feed table after inserting; a feed that is already followed stays as it is."""
    return feeds.unionByName(added.join(feeds.select(*S.FEED_KEYS), S.FEED_KEYS, "left_anti"))
