"""Small scalar expressions: times, texts sent to the user, callback payloads, links."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------------
HISTORY_SECONDS = 50_000_000
RULE_WIDTH = 86
CALLBACK_BUTTONS = ("cb_print", "cb_true", "cb_false", "cb_hide", "cb_delete")
MICROBLOG_LINK = "http://twitter.com/statuses/"
# ----------------------------------------------------------------------------------


def parse_epoch(text: Column) -> Column:
    """Decimal text to BIGINT; NULL when it is not a number."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def history_start(now: Column, seconds: int = HISTORY_SECONDS) -> Column:
    return now - F.lit(seconds)


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.unix_timestamp(later) - F.unix_timestamp(earlier)


def two_decimals(value: Column) -> Column:
    """``%.2f`` with ties to even, as C and Python round values that are exact in binary."""
    return F.when(value.isNotNull(), F.format_string("%.2f", F.bround(value, 2)))


def percent_text(percent: Column) -> Column:
    return F.concat(F.coalesce(two_decimals(percent), F.lit("nan")), F.lit("%"))


def microblog_link(post_id: Column) -> Column:
    return F.concat(F.lit(MICROBLOG_LINK), post_id)


def notification_text(score: Column, link: Column) -> Column:
    return F.concat(F.lit("Score: "), two_decimals(score), F.lit("\n"), F.coalesce(link, F.lit("")))


def full_text(title: Column, body: Column) -> Column:
    return F.concat_ws("\n", title, F.lit("-" * RULE_WIDTH), body)


def callback_payloads(site: Column, post_id: Column) -> Column:
    return F.array(*[F.concat_ws(" ", F.lit(b), site, post_id) for b in CALLBACK_BUTTONS])


def fields(text: Column) -> Column:
    """White-space separated fields of a text, without empty ones."""
    return F.regexp_extract_all(text, F.lit(r"[^\s\x0B\x85\p{Z}]+"), F.lit(0))


def parse_callback(data: Column) -> Column:
    parts = fields(data)
    return F.struct(
        F.get(parts, F.lit(0)).alias("button"),
        F.get(parts, F.lit(1)).alias("site"),
        F.get(parts, F.lit(2)).alias("post_id"),
    )


def query_string(params: dict[str, Column]) -> Column:
    """``k=v&…`` with percent-encoded values, keys in order; NULL parameters are left out."""
    pairs = [F.concat(F.lit(f"{k}="), F.url_encode(params[k])) for k in sorted(params)]
    return F.concat_ws("&", *pairs)
