import pytest
from pyspark.sql import functions as F

from feedwatch.operators import commands, routing, sites


@pytest.mark.parametrize(
    "value, query, user",
    [("Foo", "foo", "foo"), ("@Foo", "@foo", "foo"), ("a b", None, None), ("", None, None), (" x ", "x", "x")],
)
def test_follow_normalisers(spark, value, query, user):
    df = spark.createDataFrame([(value,)], "v string")
    row = df.select(sites.normalise_query(F.col("v")).alias("q"), sites.normalise_user(F.col("v")).alias("u")).first()
    assert (row["q"], row["u"]) == (query, user)


def test_site_names_are_exact(spark):
    names = ["gallery", "Gallery", "GALLERY", "Microblog", "x", None]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    got = [r[0] for r in df.select(sites.resolve_site(F.col("v"))).collect()]
    assert got == ["gallery", "gallery", None, "microblog", None, None]


def test_classify_requests(spark):
    rows = [(1, None, "gallery"), (2, "a", None), (3, "a", "zz"), (4, "none", "gallery"), (5, "a", "gallery"), (6, "b", "gallery"), (7, "b", "microblog")]
    requests = spark.createDataFrame(rows, "request_id int, post_id string, site string")
    store = spark.createDataFrame([("gallery", "a"), ("gallery", "b"), ("gallery", "b"), ("microblog", "a"), ("microblog", "b")], "site string, post_id string")
    got = commands.match_classify_requests(commands.check_classify_requests(requests), store)
    by_id = {r["request_id"]: r for r in got.collect()}
    assert [by_id[i]["success"] for i in range(1, 8)] == [False, False, False, False, True, False, True]
    assert by_id[1]["error_description"] == commands.CLASSIFY_NO_ID
    assert by_id[3]["error"] == "Cannot find site zz"
    assert by_id[4]["error"] == commands.ID_NOT_FOUND and by_id[6]["error"] == commands.ID_NOT_UNIQUE


def test_command_arity(spark):
    texts = ["/retrain", "/stats a b", "/label gallery 3", "/label gallery", "/add x y", "/other"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = commands.parse_commands(df).collect()
    assert [r["arity_ok"] for r in rows] == [True, False, True, False, True, None]
    assert [r["site"] for r in rows] == ["all", None, "gallery", None, None, None]


@pytest.mark.parametrize("score, forced, low, high", [
    (None, None, True, False), (0.4, None, True, False), (0.6, None, True, True),
    (0.9, False, False, False), (None, True, True, True), (-0.1, None, False, False),
])
def test_routing(spark, score, forced, low, high):
    df = spark.createDataFrame([("gallery", "a", forced, False, score)], "site string, post_id string, set_notify boolean, skip_write boolean, score double")
    assert (routing.route(df).count() == 1) == low
    assert (routing.route(df, 0.5).count() == 1) == high


def test_feeds_are_unique_with_the_lowest_mark(spark):
    rows = [("gallery", "tag", "x", None, 7, True), ("gallery", "tag", "x", None, 3, True)]
    df = spark.createDataFrame(rows, "site string, feed_type string, query string, last_query_time timestamp, last_post_time long, new_feed boolean")
    assert [r["last_post_time"] for r in sites.unique_feeds(df).collect()] == [3]
