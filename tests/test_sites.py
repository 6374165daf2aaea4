"""A third site, registered here, goes through following, ingest, routing, text, labelling and training."""

import pytest
from pyspark.sql import functions as F, types as T

from feedwatch.operators import commands, labelling, linear, model, routing, sites
from feedwatch.operators.model import Calibration
from feedwatch.sources import schemas as S
from feedwatch.streaming.ingest import PostStore, ingest_batch

THREADS = T.StructType(
    [T.StructField("board", T.StringType()), T.StructField("poll", T.LongType()), T.StructField("place", T.IntegerType())]
    + [T.StructField("thread", T.StringType()), T.StructField("millis", T.LongType())]
)


def as_listing(landed):
    return landed.select(
        F.lit("forum").alias("site"),
        F.lit("board").alias("feed_type"),
        F.col("board").alias("query"),
        F.col("poll").alias("poll_id"),
        F.lit(0).alias("page"),
        F.col("place").alias("pos"),
        F.col("thread").alias("post_id"),
        F.concat(F.lit("raw/"), "thread").alias("url"),
        F.expr("millis div 1000").cast("string").alias("published_time"),
        F.lit(False).alias("has_more"),
    )


def train(posts, site):
    terms = posts.sparkSession.createDataFrame([("title", "open", 1, 1.0, 2.0)], linear.MODEL_TERMS)
    return linear.TableModel(site, terms, 0.0, Calibration(1.0, 0.0))


FORUM = sites.SiteSpec(
    "forum",
    "Forum",
    THREADS,
    link=lambda post_id, url: F.concat(F.lit("https://forum.example/t/"), post_id),
    body=lambda title, description: F.upper(title),
    normalise_follow=lambda query: F.regexp_replace(sites.normalise_query(query), "^#", ""),
    feed_types={"Tag": "board"},
    first_mark=lambda now: now - 1000,
    as_listing=as_listing,
    train=train,
)


@pytest.fixture
def forum(monkeypatch):
    monkeypatch.setattr(sites, "SITES", dict(sites.SITES))
    monkeypatch.setattr(commands, "SITES", sites.SITES)
    monkeypatch.setattr(model, "SITES", sites.SITES)
    sites.register(FORUM)


def test_a_name_is_taken_once(forum):
    with pytest.raises(ValueError):
        sites.register(FORUM)


def test_a_registered_site_goes_through_the_engine(spark, forum, tmp_path):
    requests = spark.createDataFrame([("Forum", "User", "#Cats"), ("forum", "Tag", "two words"), ("Forums", "Tag", "x")], "site_arg string, kind string, text string")
    followed = sites.follow_requests(requests, F.lit(5000))
    assert [(r["site"], r["feed_type"], r["query"], r["last_post_time"], r["error"]) for r in followed.collect()] == [
        ("forum", "board", "cats", 4000, None),
        ("forum", "board", None, 4000, "query must be one word"),
        (None, None, None, -49_995_000, "invalid site name"),
    ]
    store = PostStore(spark, str(tmp_path / "store"))
    store.create(sites.new_feeds(followed))
    rows = [("cats", 0, 0, "t1", 4_500_000), ("cats", 0, 1, "t2", 4_400_999), ("cats", 0, 2, "t3", 3_999_000)]
    spark.createDataFrame(rows, THREADS).write.parquet(str(tmp_path / "landed"))
    full = [("forum", t, ("u", "ann", "regular"), f"{w} thread", "<p>x</p>", "", True, [], False) for t, w in (("t1", "open"), ("t2", "shut"))]
    metadata = spark.createDataFrame(full, S.METADATA)
    ingest_batch(store, sites.site_listing(spark, str(tmp_path / "landed"), "forum"), 0, metadata, F.timestamp_seconds(F.lit(5000)))
    posts = store.posts()
    assert sorted((r["site"], r["post_id"], r["published_time"]) for r in posts.collect()) == [("forum", "t1", 4500), ("forum", "t2", 4400)]

    assert [tuple(r) for r in model.retrain(posts, str(tmp_path / "models"), 1, ["forum"]).collect()] == [("forum", True, None)]
    fitted = linear.TableModel.load(spark, str(tmp_path / "models/site=forum"), 1)
    scored = fitted.score(posts).withColumns({"set_notify": F.lit(None).cast("boolean"), "skip_write": F.lit(False)})
    sent = routing.notifications(routing.route(scored, 0.6)).collect()
    assert [(r["post_id"], r["link"]) for r in sent] == [("t1", "https://forum.example/t/t1")]
    texts = {r["post_id"]: r["text"].split("\n", 1)[1] for r in routing.printed_posts(scored).collect()}
    assert texts == {"t1": "OPEN THREAD", "t2": "SHUT THREAD"}

    selected = fitted.select_to_label(posts, 1, ratio=0.0)
    found, _ = labelling.find_selected(selected, posts)
    assert [r["post_id"] for r in labelling.label_messages(found).collect()] == ["t2"]
    asked = commands.parse_commands(spark.createDataFrame([("/label Forum 3",)], "text string")).first()
    assert asked["site"] == "forum" and asked["arity_ok"]
    known = commands.check_site_requests(spark.createDataFrame([("forum",), ("other",)], "site string"), "stats").collect()
    assert [r["success"] for r in known] == [True, False]


def test_listings_of_a_site_as_a_stream(spark, forum, tmp_path):
    spark.createDataFrame([("cats", 0, 0, "t1", 1000)], THREADS).write.parquet(str(tmp_path / "landed"))
    stream = sites.site_listing(spark, str(tmp_path / "landed"), "forum", files_per_trigger=1)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert [r["published_time"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["1"]
