"""Ticks with early wake, models switched under a running stream, replies that can't be read."""

from pyspark.sql import functions as F, types as T
from test_ingest import FEED, feeds
from test_model import posts, toy

from feedwatch.operators import linear, model, routing
from feedwatch.operators.model import Calibration
from feedwatch.sources import schemas as S
from feedwatch.sources.tables import broken_replies, decode_classification
from feedwatch.streaming.ingest import PostStore
from feedwatch.streaming.models import CurrentModels, current_version, publish, start_versioned_classifier
from feedwatch.streaming.tick import TICK, Polling, polling_stream, start_polling


def at(spark, rows):
    """rows: (second, query or None)"""
    made = [(t, *(("gallery", "user", q) if q else (None,) * 3), None, 7 if q else None, True if q else None) for t, q in rows]
    schema = "t long, site string, feed_type string, query string, last_query_time timestamp, last_post_time long, new_feed boolean"
    df = spark.createDataFrame(made, schema)
    return df.select(F.timestamp_seconds("t").alias("tick"), *S.FEED.fieldNames())


def asked(polling):
    rows = polling.requests().select(F.unix_timestamp("asked_at").alias("t"), "query", "woken").collect()
    return sorted((r["t"], r["query"], r["woken"]) for r in rows)


def test_a_followed_feed_is_asked_for_before_the_interval_ends(spark, tmp_path):
    store = PostStore(spark, str(tmp_path / "store"))
    store.create(feeds(spark))
    polling = Polling(store)
    first = FEED[2]
    batches = [[(1000, None)], [(1060, "late"), (1060, first)], [(1120, None), (1200, None)], [(1301, None)], [(1360, None), (1359, "next")]]
    for n, rows in enumerate(batches):
        for _ in range(2 if n in (1, 3) else 1):  # a replay asks for the same
            polling.step(at(spark, rows), n)
    want = [(1000, first, False), (1060, "late", True), (1301, first, False), (1360, "late", False), (1360, "next", True)]
    assert asked(polling) == sorted(want)


def test_a_poll_that_landed_counts_as_asked(spark, tmp_path):
    store = PostStore(spark, str(tmp_path / "store"))
    store.create(feeds(spark))
    polling = Polling(store)
    polling.step(at(spark, [(1000, None)]), 0)
    store.feed_table.write(feeds(spark).withColumn("last_query_time", F.timestamp_seconds(F.lit(1200))), 0)
    polling.step(at(spark, [(1400, None)]), 1)
    polling.step(at(spark, [(1500, None)]), 2)
    polling.step(at(spark, []), 3)
    assert [t for t, _, _ in asked(polling)] == [1000, 1500]


def test_ticks_and_follows_as_streams(spark, tmp_path):
    store = PostStore(spark, str(tmp_path / "store"))
    store.create(feeds(spark))
    polling = Polling(store)
    for ticks, follows in (([(1000, None)], []), ([], [(1010, "late")])):
        at(spark, ticks).select("tick").write.mode("append").parquet(str(tmp_path / "ticks"))
        at(spark, follows).write.mode("append").parquet(str(tmp_path / "follows"))
        both = polling_stream(
            spark.readStream.schema(TICK).parquet(str(tmp_path / "ticks")),
            spark.readStream.schema(T.StructType([*TICK.fields, *S.FEED.fields])).parquet(str(tmp_path / "follows")),
        )
        start_polling(polling, both).awaitTermination()
    assert asked(polling) == [(1000, FEED[2], False), (1010, "late", True)]


def table(spark, weight):
    terms = spark.createDataFrame([("title", "open", 1, 1.0, weight)], linear.MODEL_TERMS)
    return linear.TableModel("gallery", terms, 0.0, Calibration(1.0, 0.0))


def test_a_running_stream_takes_the_next_version(spark, tmp_path):
    path, out = str(tmp_path / "models"), str(tmp_path / "out")
    landed = posts(spark, [("a", "open now", "", None), ("b", "closed", "", None)])
    landed = landed.unionByName(landed.where("post_id = 'a'").withColumn("site", F.lit("microblog")))
    landed = landed.withColumns({"set_notify": F.lit(None).cast("boolean"), "skip_write": F.lit(False)})
    for n in range(3):
        landed.coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
    versions = {}

    def load(folder, version):
        versions.setdefault(version, 0)
        versions[version] += 1
        return linear.TableModel.load(spark, folder, version)

    class Switching(CurrentModels):
        """Publishes the next version while the stream runs: before the first and the third micro-batch."""

        batches = 0

        def __call__(self):
            if self.batches in (0, 2):
                version = self.batches // 2 + 1
                table(spark, 3.0 if version == 1 else -3.0).save(f"{path}/site=gallery", version)
                publish(spark, path, "gallery", version)
            self.batches += 1
            return super().__call__()

    models = Switching(spark, path, ["gallery", "microblog"], load)
    stream = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "landing"))
    start_versioned_classifier(stream, models, out, str(tmp_path / "c")).awaitTermination()
    rows = spark.read.parquet(out).where("site = 'gallery' AND post_id = 'a'").orderBy("batch").collect()
    assert [r["version"] for r in rows] == [1, 1, 2] and versions == {1: 1, 2: 1}
    assert [round(r["score"], 3) for r in rows] == [0.953, 0.953, 0.047]
    unknown = spark.read.parquet(out).where("site = 'microblog'").collect()
    assert len(unknown) == 3 and all(r["classify_error"] and r["version"] is None for r in unknown)


def test_an_unpublished_version_does_not_count(spark, tmp_path):
    path = str(tmp_path / "models")
    table(spark, 1.0).save(f"{path}/site=gallery", 4)
    assert current_version(spark, path, "gallery") is None
    publish(spark, path, "gallery", 4)
    assert current_version(spark, path, "gallery") == 4


def test_sites_are_trained_side_by_side(spark, tmp_path):
    both = toy(spark).unionByName(toy(spark).withColumn("site", F.lit("microblog")))
    rows = model.retrain(both, str(tmp_path), 2, ["gallery", "microblog"]).collect()
    assert sorted(map(tuple, rows)) == [("gallery", True, None), ("microblog", True, None)]
    assert all(model.NotificationModel.load(f"{tmp_path}/site={s}", 2).reason is None for s in ("gallery", "microblog"))


def test_replies_that_cannot_be_read(spark):
    bodies = ['{"results":[],"has_more":false}', "", None, "  ", "{", "[1", '{"has_more":true}', "null", '{"results":null}', '{"results":[{"url":"u"}]}']
    df = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    got = {r["n"]: r["reason"] for r in broken_replies(df, S.LISTING_REPLY, "results").collect()}
    assert got == {1: "empty", 2: "empty", 3: "empty", 4: "not parsed", 5: "not parsed", 6: "no results", 7: "not parsed", 8: "no results"}


def test_answers_feed_the_routing(spark):
    bodies = ['{"success":true,"score":0.4,"notify":false}', '{"success":false,"error":"e","score":0.9}', "oops", None, '{"success":true}']
    df = spark.createDataFrame(list(enumerate(bodies)), "post_id int, body string")
    answers = decode_classification(df).withColumns({"set_notify": F.lit(None).cast("boolean"), "skip_write": F.lit(False)})
    routed = {r["post_id"]: (r["score"], r["classify_error"], r["classify_failure"]) for r in routing.route(answers).collect()}
    lost = (0.0, True, "answer not understood")
    assert routed == {0: (0.4, False, None), 1: (0.0, True, "e"), 2: lost, 3: lost, 4: lost}
