import random

from pyspark.sql import functions as F

from feedwatch.operators import ingest as I
from feedwatch.sources import schemas as S
from feedwatch.sources.tables import stream_listing
from feedwatch.streaming.ingest import PostStore, ingest_batch, start_ingest

FEED = ("gallery", "user", "ann")


def listing(spark, polls, page_size=2):
    """``polls``: {poll_id: [(post_id, time text), …]} of one feed."""
    rows = []
    for poll_id, posts in polls.items():
        for i, (post_id, time) in enumerate(posts):
            more = i // page_size < (len(posts) - 1) // page_size
            rows.append((*FEED, poll_id, i // page_size, i % page_size, post_id, f"u{poll_id}-{i}", time, more))
    return spark.createDataFrame(rows, S.LISTING)


def feeds(spark, mark=100, new=False):
    return spark.createDataFrame([(*FEED, None, mark, new)], S.FEED)


def metadata(spark, ids):
    rows = [("gallery", i, None, f"title {i}", "", "", True, [], False) for i in ids]
    return spark.createDataFrame(rows, S.METADATA)


def accept(spark, polls, mark=100, **kw):
    rows, _ = I.split_listing(listing(spark, polls))
    marks = I.poll_marks(rows, feeds(spark, mark), kw.get("max_pages"))
    return I.new_posts(rows, marks, **kw), marks


def ids(df):
    return sorted(r["post_id"] for r in df.select("post_id").collect())


def test_mark_is_strict_and_bad_times_are_quarantined(spark):
    rows = listing(spark, {0: [("a", "102"), ("b", "x"), ("c", "100"), ("d", "99")]})
    good, bad = I.split_listing(rows)
    new = I.new_posts(good, I.poll_marks(good, feeds(spark)))
    assert ids(new) == ["a"] and ids(bad) == ["b"]


def test_prefix_stops_at_the_first_old_post(spark):
    polls = {0: [("a", "105"), ("old", "90"), ("late", "104")]}
    assert ids(accept(spark, polls)[0]) == ["a", "late"]
    assert ids(accept(spark, polls, prefix=True)[0]) == ["a"]


def test_prefix_equals_filter_on_newest_first_input(spark):
    rng = random.Random(7)
    for _ in range(3):
        times = sorted((rng.randrange(80, 130) for _ in range(12)), reverse=True)
        polls = {0: [(str(i), str(t)) for i, t in enumerate(times)]}
        assert ids(accept(spark, polls)[0]) == ids(accept(spark, polls, prefix=True)[0])


def test_page_cap_marks_poll_as_truncated(spark):
    polls = {0: [(str(i), str(200 - i)) for i in range(30)]}
    new, marks = accept(spark, polls, max_pages=I.MAX_PAGES)
    row = marks.first()
    assert len(ids(new)) == 20 and row["truncated"] and row["mark_after"] == 200
    _, marks = accept(spark, {0: polls[0][:20]}, max_pages=I.MAX_PAGES)
    assert not marks.first()["truncated"]


def test_pages_after_the_last_one_are_not_read(spark):
    rows = listing(spark, {0: [(str(i), str(200 - i)) for i in range(6)]})
    rows = rows.withColumn("has_more", F.col("page") == 1)  # page 0 says it is the last
    good, _ = I.split_listing(rows)
    assert ids(I.new_posts(good, I.poll_marks(good, feeds(spark)))) == ["0", "1"]


def test_mark_of_a_poll_is_the_one_after_the_polls_before(spark):
    polls = {0: [("a", "110"), ("b", "101")], 1: [("c", "112"), ("d", "110"), ("e", "105")], 2: [("f", "90")]}
    new, marks = accept(spark, polls)
    assert ids(new) == ["a", "b", "c"]
    assert [r["mark_before"] for r in marks.orderBy("poll_id").collect()] == [100, 110, 112]


def test_override_of_new_feeds(spark, hot_keys):
    for n in (4, 5, 6):
        polls = {0: [(str(i), str(200 - i)) for i in range(n)], 1: [("later", "300")]}
        rows, _ = I.split_listing(listing(spark, polls))
        new = I.new_posts(rows, I.poll_marks(rows, feeds(spark, new=True)))
        known = I.known_posts(new, metadata(spark, [str(i) for i in range(n)] + ["later"]))
        got = {r["post_id"]: r["set_notify"] for r in I.override_new_feeds(known).collect()}
        assert got.pop("later") is None
        assert got == {str(i): i < 5 for i in range(n)}


def test_last_url_wins_and_post_counts_once_per_poll(spark):
    new, _ = accept(spark, {0: [("a", "110"), ("b", "109"), ("a", "108")]})
    rows = {r["post_id"]: r["url"] for r in I.enrich(new, metadata(spark, ["a", "b"])).collect()}
    assert rows == {"a": "u0-2", "b": "u0-1"}


def test_insert_if_absent(spark):
    batch = spark.createDataFrame([("g", "a", 2, "x"), ("g", "a", 1, "y"), ("g", "b", 1, "z")], "site string, post_id string, n int, v string")
    stored = spark.createDataFrame([("g", "b")], "site string, post_id string")
    got = I.insert_if_absent(batch, stored, ["n"])
    assert [tuple(r) for r in got.collect()] == [("g", "a", 1, "y")]
    after = stored.unionByName(got.select("site", "post_id"))
    assert I.insert_if_absent(batch, after, ["n"]).count() == 0


def test_chunks_keep_order(spark):
    new, _ = accept(spark, {0: [(str(i), str(300 - i)) for i in range(7)]})
    rows = I.metadata_chunks(new, size=3).orderBy("position").collect()
    assert [r["post_id"] for r in rows] == [str(i) for i in range(7)]
    assert [r["chunk"] for r in rows] == [0, 0, 0, 1, 1, 1, 2]


def test_due_feeds_put_new_ones_first(spark):
    rows = [("gallery", "user", q, t, 0, n) for q, t, n in [("late", 400, False), ("new", None, True), ("soon", 50, False)]]
    df = spark.createDataFrame(rows, "site string, feed_type string, query string, t long, last_post_time long, new_feed boolean")
    df = df.withColumn("last_query_time", F.timestamp_seconds(F.lit(1000) - F.col("t")))
    due = I.due_feeds(df, F.timestamp_seconds(F.lit(1000)))
    assert [r["query"] for r in due.collect()] == ["new", "late"]


def test_replayed_batch_changes_nothing(spark, tmp_path):
    store = PostStore(spark, str(tmp_path / "store"))
    store.create(feeds(spark))
    rows = listing(spark, {0: [("a", "110"), ("b", "105"), ("a", "104")]})
    meta = metadata(spark, ["a", "b"])

    def snapshot():
        return (
            sorted(map(str, store.posts().collect())),
            sorted(map(str, store.messages().collect())),
            store.feeds(0).collect(),
        )

    ingest_batch(store, rows, 0, meta, F.timestamp_seconds(F.lit(1000)))
    once = snapshot()
    ingest_batch(store, rows, 0, meta, F.timestamp_seconds(F.lit(1000)))
    assert snapshot() == once
    assert store.feeds(0).first()["last_post_time"] == 110
    ingest_batch(store, rows, 1, meta, F.timestamp_seconds(F.lit(2000)))
    assert store.posts().count() == 2 and store.messages().count() == 2


def test_a_poll_in_several_batches_is_judged_by_the_mark_it_started_from(spark, tmp_path):
    polls = {0: [("a", "110"), ("b", "105"), ("c", "90"), ("d", "104")]}
    meta = metadata(spark, list("abcd"))
    found = []
    for name, files in (("whole", 1), ("split", 4)):
        base = str(tmp_path / name)
        store = PostStore(spark, f"{base}/store")
        store.create(feeds(spark))
        rows = listing(spark, polls)
        rows.repartition(files, "post_id").write.parquet(f"{base}/landing")
        stream = stream_listing(spark, f"{base}/landing", files_per_trigger=1)
        start_ingest(store, stream, meta, lambda: F.timestamp_seconds(F.lit(5000))).awaitTermination()
        last = spark.read.parquet(store.feeds_path).agg(F.max("batch")).first()[0]
        found.append((ids(store.posts()), store.feeds(last).collect()))
    assert found[0] == found[1]
    assert found[0][0] == ["a", "b", "d"]


def test_messages_of_a_new_feed_do_not_depend_on_micro_batches(spark, tmp_path):
    posts = [(str(i), str(300 - i)) for i in range(12)] + [("2", "280"), ("11", "279")]
    meta = metadata(spark, [str(i) for i in range(12) if i != 1])
    ways = {"whole": [range(7)], "in order": [[k] for k in range(7)], "backwards": [[k] for k in range(6, -1, -1)]}
    found = {}
    for name, batches in ways.items():
        store = PostStore(spark, str(tmp_path / name))
        store.create(feeds(spark, new=True))
        for n, pages in enumerate(batches):
            rows = listing(spark, {0: posts}).where(F.col("page").isin(*pages))
            ingest_batch(store, rows, n, meta, F.timestamp_seconds(F.lit(5000)))
        found[name] = sorted(((r["post_id"], r["set_notify"], r["url"]) for r in store.messages().collect()), key=str)
        if name == "in order":
            sent = spark.read.parquet(store.messages_path).where("set_notify")
            assert ids(sent) == ["0", "2", "3", "4", "5"]
    assert found["whole"] == found["in order"] == found["backwards"]
    assert [p for p, flag, _ in found["whole"] if flag] == ["0", "2", "3", "4", "5"]
    assert all(flag is not None for _, flag, _ in found["whole"]) and ("2", True, "u0-12") in found["whole"]


def test_pages_after_a_poll_s_last_one_are_not_read_in_later_batches(spark, tmp_path):
    store = PostStore(spark, str(tmp_path / "store"))
    store.create(feeds(spark))
    rows = listing(spark, {0: [("a", "110"), ("b", "109"), ("c", "120"), ("d", "119")]}).withColumn("has_more", F.lit(False))
    for n in (0, 1):
        ingest_batch(store, rows.where(F.col("page") == n), n, metadata(spark, list("abcd")), F.timestamp_seconds(F.lit(5000)))
    assert ids(store.messages()) == ids(store.posts()) == ["a", "b"]
    assert store.feeds(1).first()["last_post_time"] == 110


def test_same_id_on_two_sites_is_two_posts(spark):
    rows = [(s, "7", f"{s}/7", 0, 0, 0, "110") for s in ("gallery", "microblog")]
    batch = spark.createDataFrame(rows, "site string, post_id string, url string, poll_id long, page int, pos int, t string")
    stored = spark.createDataFrame([("microblog", "8")], "site string, post_id string")
    assert I.insert_if_absent(batch, stored, ["poll_id"]).count() == 2
    stored = spark.createDataFrame([("microblog", "7")], "site string, post_id string")
    assert [r["site"] for r in I.insert_if_absent(batch, stored, ["poll_id"]).collect()] == ["gallery"]


def test_empty_poll_counts_as_polled(spark):
    polls = spark.createDataFrame([(*FEED, 0)], "site string, feed_type string, query string, poll_id long")
    rows, _ = I.split_listing(listing(spark, {}))
    marks = I.poll_marks(rows, feeds(spark, new=True), polls=polls)
    after = I.advance_feeds(feeds(spark, new=True), marks, F.timestamp_seconds(F.lit(1000))).first()
    assert not after["new_feed"] and after["last_query_time"] is not None and after["last_post_time"] == 100


def test_take_while_mark_comes_from_accepted_rows(spark):
    rows, _ = I.split_listing(listing(spark, {0: [("a", "105"), ("old", "90"), ("late", "110")]}))
    marks = I.poll_marks(rows, feeds(spark))
    assert I.take_while_marks(rows, marks).first()["mark_after"] == 105


def test_stream_in_rounds_equals_one_batch(spark, tmp_path):
    polls = {
        0: [("a", "110"), ("b", "105")],
        1: [("c", "115"), ("d", "112"), ("a", "110")],
        2: [("e", "120"), ("a", "119")],
    }
    meta = metadata(spark, list("abcde"))
    results = []
    for name, rounds in (("once", [polls]), ("rounds", [{k: v} for k, v in polls.items()])):
        base = str(tmp_path / name)
        store = PostStore(spark, f"{base}/store")
        store.create(feeds(spark))
        for part in rounds:
            listing(spark, part).write.mode("append").parquet(f"{base}/landing")
            stream = stream_listing(spark, f"{base}/landing", files_per_trigger=1000)
            clock = lambda: F.timestamp_seconds(F.lit(5000))
            start_ingest(store, stream, meta, clock).awaitTermination()
        last = spark.read.parquet(store.feeds_path).agg(F.max("batch")).first()[0]
        posts = sorted((r["post_id"], r["url"], r["published_time"]) for r in store.posts().collect())
        results.append((posts, store.feeds(last).collect(), sorted(ids(store.messages()))))
    assert results[0] == results[1]
    assert results[0][2] == ["a", "a", "b", "c", "d", "e"]
