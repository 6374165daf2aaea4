"""Validation of commands and service requests, as columns over a table of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.formats import fields
from .sites import SITES, resolve_site
from .skew import lookup_join

# --- fixed values -----------------------------------------------------------------
MAX_OPTIONAL_ARGS = {"retrain": 1, "stats": 1}
EXACT_ARGS = {"label": 2, "add": 2}
INVALID_REQUEST = "invalid_request"
UNKNOWN_SITE = "Cannot find site "
RETRAIN_NO_SITE = "Must provide the site to rebuild model for"
STATS_NO_SITE = "Must provide the site to get statistics for"
LABEL_NO_COUNT = "Must number of posts to label."
LABEL_NO_SITE = "Must provide the site to get posts for."
CLASSIFY_NO_ID = "Must provide an id to be classified."
CLASSIFY_NO_SITE = "Must provide the site associated with the id."
ID_NOT_FOUND = "id not found in database."
ID_NOT_UNIQUE = "id is not unique in database"
# ----------------------------------------------------------------------------------


def parse_commands(commands: DataFrame, text: str = "text") -> DataFrame:
    """``/name arg …`` texts: name, arguments, whether the number of arguments fits, site."""
    words = fields(F.col(text))
    name = F.regexp_extract(F.get(words, F.lit(0)), "^/(.+)$", 1)
    n = F.size("args")
    fits = F.lit(None).cast("boolean")
    for command, most in MAX_OPTIONAL_ARGS.items():
        fits = F.when(F.col("command") == command, n <= most).otherwise(fits)
    for command, exact in EXACT_ARGS.items():
        fits = F.when(F.col("command") == command, n == exact).otherwise(fits)
    site_arg = F.get("args", F.lit(0))
    optional = F.col("command").isin(*MAX_OPTIONAL_ARGS)
    site = F.when(n > 0, resolve_site(site_arg)).when(optional, "all")
    return (
        commands.withColumn("command", name)
        .withColumn("args", F.slice(words, 2, 1 << 30))
        .withColumn("arity_ok", fits)
        .withColumn("site", F.when(F.col("arity_ok"), site))
    )


def is_known_site(site: Column) -> Column:
    return site.isin(*SITES)


def _unknown(site: Column) -> Column:
    return F.concat(F.lit(UNKNOWN_SITE), site)


def check_site_requests(requests: DataFrame, purpose: str) -> DataFrame:
    """Retrain and statistics requests: a site is given, and is known or ``all``."""
    site = F.col("site")
    missing = {"retrain": RETRAIN_NO_SITE, "stats": STATS_NO_SITE}[purpose]
    error = F.when(site.isNull(), missing).when(
        (site != "all") & ~is_known_site(site), _unknown(site)
    )
    return requests.withColumn("error", error).withColumn("success", F.col("error").isNull())


def check_label_requests(requests: DataFrame) -> DataFrame:
    """Label requests: count given and a number, site given and known, in that order."""
    site, count = F.col("site"), F.col("count_arg")
    number = count.try_cast("int")
    bad = F.lit(INVALID_REQUEST)
    error = (
        F.when(count.isNull(), bad)
        .when(number.isNull(), F.concat(F.lit("not a number: "), count))
        .when(site.isNull(), bad)
        .when(~is_known_site(site), _unknown(site))
    )
    description = F.when(count.isNull(), LABEL_NO_COUNT).when(
        number.isNotNull() & site.isNull(), LABEL_NO_SITE
    )
    return (
        requests.withColumn("count", number)
        .withColumn("error", error)
        .withColumn("error_description", description)
        .withColumn("success", F.col("error").isNull())
    )


def check_classify_requests(requests: DataFrame) -> DataFrame:
    """Classify requests: id given, site given, site known, in that order."""
    site, post_id = F.col("site"), F.col("post_id")
    bad = F.lit(INVALID_REQUEST)
    return requests.withColumn(
        "error",
        F.when(post_id.isNull() | site.isNull(), bad).when(~is_known_site(site), _unknown(site)),
    ).withColumn(
        "error_description",
        F.when(post_id.isNull(), CLASSIFY_NO_ID).when(
            site.isNull(), CLASSIFY_NO_SITE
        ),
    )


def match_classify_requests(checked: DataFrame, posts: DataFrame) -> DataFrame:
    """Adds the number of stored posts per valid request; exactly one is a success.

    Posts are counted per site and id first, so a repeated id never multiplies request rows.
    """
    stored = posts.groupBy(F.col("site").alias("_site"), F.col("post_id").alias("_id")).agg(F.count(F.lit(1)).alias("stored"))
    keyed = checked.withColumn("_site", F.coalesce("site", F.lit(""))).withColumn("_id", F.coalesce("post_id", F.lit("")))
    matched = lookup_join(keyed, stored, ["_site", "_id"], spread_by=["request_id"], how="left").drop("_site", "_id")
    n = F.coalesce("stored", F.lit(0))
    valid = F.col("error").isNull()
    error = F.when(~valid, F.col("error")).when(n == 0, ID_NOT_FOUND).when(
        n > 1, ID_NOT_UNIQUE
    )
    return (
        matched.withColumn("n_matches", F.when(valid, n))
        .withColumn("error", error)
        .withColumn("success", F.col("error").isNull())
        .drop("stored")
    )


def answer_classify_requests(matched: DataFrame, scored: DataFrame, notify_cutoff: float = 0.5) -> DataFrame:
    """Adds score and notify to the requests that succeed, NULL to the others.

    ``scored`` (site, post_id, score) is what a site's model gives its stored posts.
    """
    keyed = matched.withColumn("_site", F.when(F.col("success"), F.col("site"))).withColumn(
        "_id", F.when(F.col("success"), F.col("post_id"))
    )
    scores = scored.select(F.col("site").alias("_site"), F.col("post_id").alias("_id"), "score")
    answered = lookup_join(keyed, scores, ["_site", "_id"], spread_by=["request_id"], how="left")
    return answered.drop("_site", "_id").withColumn("notify", F.col("score") >= notify_cutoff)
