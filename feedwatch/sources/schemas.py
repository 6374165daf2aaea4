"""Explicit schemas of everything the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

AUTHOR = T.StructType(
    [
        T.StructField("userid", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("user_type", T.StringType()),
    ]
)
TAG = T.StructType(
    [
        T.StructField("tag_name", T.StringType()),
        T.StructField("sponsored", T.BooleanType()),
        T.StructField("sponsor", T.StringType()),
    ]
)
METADATA = T.StructType(
    [
        T.StructField("site", T.StringType()),
        T.StructField("post_id", T.StringType()),
        T.StructField("author", AUTHOR),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("license", T.StringType()),
        T.StructField("allows_comments", T.BooleanType()),
        T.StructField("tags", T.ArrayType(TAG)),
        T.StructField("is_mature", T.BooleanType()),
    ]
)
POST = T.StructType(
    METADATA.fields
    + [
        T.StructField("url", T.StringType()),
        T.StructField("notify", T.BooleanType()),
        T.StructField("published_time", T.LongType()),
    ]
)
FEED = T.StructType(
    [
        T.StructField("site", T.StringType()),
        T.StructField("feed_type", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("last_query_time", T.TimestampType()),
        T.StructField("last_post_time", T.LongType()),
        T.StructField("new_feed", T.BooleanType()),
    ]
)
LISTING = T.StructType(
    [
        T.StructField("site", T.StringType()),
        T.StructField("feed_type", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("poll_id", T.LongType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("post_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("published_time", T.StringType()),
        T.StructField("has_more", T.BooleanType()),
    ]
)
MESSAGE = T.StructType(
    [
        T.StructField("site", T.StringType()),
        T.StructField("post_id", T.StringType()),
        T.StructField("set_notify", T.BooleanType()),
        T.StructField("skip_write", T.BooleanType()),
    ]
)
FEEDBACK = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("site", T.StringType()),
        T.StructField("post_id", T.StringType()),
    ]
)

# Replies of the upstream site and of the classifier, as JSON text. Field names.
LISTING_REPLY = T.StructType(
    [
        T.StructField(
            "results",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("published_time", T.StringType()),
                        T.StructField("deviationid", T.StringType()),
                        T.StructField("url", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("has_more", T.BooleanType()),
        T.StructField("next_offset", T.LongType()),
    ]
)
CLASSIFICATION = T.StructType(
    [
        T.StructField("success", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("error_description", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("site", T.StringType()),
        T.StructField("notify", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
    ]
)

FEED_KEYS = ["site", "feed_type", "query"]
POLL_KEYS = [*FEED_KEYS, "poll_id"]
POST_KEYS = ["site", "post_id"]
