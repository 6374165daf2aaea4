"""Batch tables, the post store under feedback, take-while over several polls: against plain replays."""

import random

from pyspark.sql import functions as F
from test_feedback import OPS, replay
from test_ingest import FEED, feeds, ids, listing, metadata

from feedwatch.operators import ingest as I
from feedwatch.operators.feedback import FOLD, fold_stretch, live_posts, merge_folds
from feedwatch.sources import schemas as S
from feedwatch.sources.batches import BatchTable, Snapshots, remove_folder
from feedwatch.sources.tables import stream_listing
from feedwatch.streaming.ingest import PostStore, first_listed, ingest_batch, service_stream, start_ingest

def clock():
    return F.timestamp_seconds(F.lit(5000))



def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def test_batches_are_merged_and_few_folders_are_read(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), numbers(spark, 1).schema, fan_in=3)
    most = 0
    for n in range(14):
        table.tidy(n)
        table.write(numbers(spark, n, n + 100), n)
        if n in (5, 9):  # a replay reads nothing of its own batch and leaves the same
            table.tidy(n)
            assert sorted(r["v"] for r in table.read(before=n).collect()) == sorted([*range(n), *range(100, 100 + n)])
            table.write(numbers(spark, n, n + 100), n)
        most = max(most, len(table.runs()))
    assert most <= 6 and table.runs() == [(0, 8), (9, 11), (12, 12), (13, 13)]
    rows = table.read().collect()
    assert sorted((r["v"], r["batch"]) for r in rows) == sorted([(n, n) for n in range(14)] + [(n + 100, n) for n in range(14)])


def test_an_unfinished_merge_does_not_count(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), numbers(spark, 1).schema, fan_in=2)
    for n in range(2):
        table.write(numbers(spark, n), n)
    table.tidy(2)
    remove_folder(spark, f"{table.run_path(0, 1)}/_SUCCESS")
    assert table.runs() == [(0, 0), (1, 1)] and table.read().count() == 2
    table.tidy(2)
    assert table.runs() == [(0, 1)] and table.read().count() == 2


def test_old_snapshots_go(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "s"), numbers(spark, 1).schema)
    for n in range(-1, 4):
        table.write(numbers(spark, n), n)
        table.tidy(n)
    assert table.last() == 3 and table.read(3).first()["v"] == 3
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["batch=1", "batch=2", "batch=3"]


def test_folds_of_a_log_cut_anywhere_equal_its_replay(spark, hot_keys):
    rng = random.Random(11)
    log = [(seq, rng.choice(OPS), "gallery", str(rng.randrange(400))) for seq in range(4000)]
    for cuts in ((1000, 1010, 2500), (3999,), (1, 2, 3, 2000)):
        merged = spark.createDataFrame([], FOLD).withColumn("batch", F.lit(0).cast("long"))
        for n, (a, b) in enumerate(zip((0, *cuts), (*cuts, len(log)), strict=True)):
            part = fold_stretch(spark.createDataFrame(log[a:b], S.FEEDBACK))
            merged = merged.unionByName(part.withColumns({"stored_at": F.lit(n).cast("long"), "batch": F.lit(n).cast("long")}))
            if n == 1:  # states may be merged early, as the store does
                merged = merge_folds(merged)
        got = {r["post_id"]: r["notify"] for r in live_posts(merge_folds(merged)).collect()}
        assert got == replay(log)


def press(spark, *ops):
    return spark.createDataFrame([(seq, op, "gallery", post) for seq, op, post in ops], S.FEEDBACK)


def state(store):
    return sorted(((r["post_id"], r["notify"], r["published_time"]) for r in store.posts().collect()), key=str)


def test_labels_and_deletes_are_seen_by_ingest(spark, tmp_path):
    meta = metadata(spark, list("abcd"))
    for words in (1, 1 << 20):  # with one word the filter lets everything through to the exact comparison
        store = PostStore(spark, str(tmp_path / f"store{words}"), buckets=2, words=words)
        store.create(feeds(spark))
        rounds = [
            ({0: [("a", "110"), ("b", "109"), ("c", "108")]}, press(spark, (1, "cb_true", "a"), (2, "cb_delete", "b"), (3, "cb_false", "d"))),
            ({1: [("b", "120"), ("a", "119"), ("d", "118")]}, press(spark, (4, "cb_delete", "c"), (5, "cb_false", "a"))),
            ({2: [("c", "130"), ("d", "129")]}, press(spark, (6, "cb_true", "c"))),
        ]
        for n, (polls, ops) in enumerate(rounds):
            for _ in range(2 if n == 1 else 1):  # a replay changes nothing
                ingest_batch(store, listing(spark, polls), n, meta, clock(), feedback=ops)
        assert state(store) == [("a", False, 110), ("b", None, 120), ("c", True, 130), ("d", None, 118)]
        assert {r["post_id"]: r["notify"] for r in store.labels(before=1).collect()} == {"a": True, "c": None}


def test_listing_feedback_and_follows_in_one_stream(spark, tmp_path):
    base = str(tmp_path)
    store = PostStore(spark, f"{base}/store")
    store.create(feeds(spark))
    listing(spark, {}).write.parquet(f"{base}/landing")
    press(spark).write.parquet(f"{base}/pressed")
    other = spark.createDataFrame([("gallery", "user", "late", None, 100, True)], S.FEED)
    other.write.parquet(f"{base}/follows")
    rows = listing(spark, {0: [("a", "110"), ("b", "109")]})
    unfollowed = rows.withColumn("query", F.lit("nobody"))
    added = rows.where("post_id = 'b'").withColumns({"query": F.lit("late"), "post_id": F.lit("z")})

    def run():
        streams = [spark.readStream.schema(s).parquet(f"{base}/{p}") for p, s in (("landing", S.LISTING), ("pressed", S.FEEDBACK), ("follows", S.FEED))]
        start_ingest(store, service_stream(*streams), metadata(spark, list("abz")), clock).awaitTermination()

    rows.unionByName(unfollowed).unionByName(added).write.mode("append").parquet(f"{base}/landing")
    press(spark, (1, "cb_true", "b"), (2, "cb_print", "a")).write.mode("append").parquet(f"{base}/pressed")
    run()
    assert state(store) == [("a", None, 110), ("b", True, 109), ("z", None, 109)]
    press(spark, (3, "cb_delete", "a"), (4, "cb_false", "z")).write.mode("append").parquet(f"{base}/pressed")
    run()
    assert state(store) == [("b", True, 109), ("z", False, 109)]
    assert sorted(r["query"] for r in store.feeds().collect()) == sorted([FEED[2], "late"])
    assert ids(store.messages()) == ["a", "b", "z"]


def test_rows_of_closed_polls_are_quarantined(spark, tmp_path):
    store = PostStore(spark, str(tmp_path / "store"))
    store.create(feeds(spark))
    meta = metadata(spark, [str(i) for i in range(9)])
    ingest_batch(store, listing(spark, {k: [(str(k), str(110 + k))] for k in range(6)}), 0, meta, clock())
    late = listing(spark, {k: [(f"{8 - k}", str(112 + k))] for k in (1, 2)})
    ingest_batch(store, late, 1, meta, clock())
    # polls 2 to 5 are open: a row of poll 2 is judged by the mark that poll started from
    assert ids(spark.read.parquet(f"{store.quarantine_path}/batch=1")) == ["7"]
    assert ids(store.posts()) == ["0", "1", "2", "3", "4", "5", "6"]


def plain_take_while(polls, mark):
    accepted, marks = [], []
    for poll_id in sorted(polls):
        before = mark
        for post, t in polls[poll_id]:
            if int(t) <= before:
                break
            accepted.append((poll_id, post))
            mark = max(mark, int(t))
        marks.append((poll_id, before, mark))
    return accepted, marks


def unordered(rng, n_polls):
    return {k: [(f"{k}-{i}", str(95 + 3 * k + rng.randrange(20))) for i in range(rng.randrange(1, 12))] for k in range(n_polls)}


def test_take_while_over_several_unordered_polls_equals_poll_by_poll(spark):
    rng = random.Random(2)
    many = {f"q{f}": unordered(rng, rng.randrange(1, 6)) for f in range(40)}
    rows, table = None, None
    for q, polls in many.items():
        part = listing(spark, polls).withColumn("query", F.lit(q))
        rows = part if rows is None else rows.unionByName(part)
        feed = feeds(spark).withColumn("query", F.lit(q))
        table = feed if table is None else table.unionByName(feed)
    rows, _ = I.split_listing(rows.coalesce(4))
    marks = I.poll_marks(rows, table.coalesce(2), prefix=True)
    got = {}
    for r in I.new_posts(rows, marks, prefix=True).select("query", "poll_id", "post_id").collect():
        got.setdefault(r["query"], set()).add((r["poll_id"], r["post_id"]))
    found = {}
    for r in marks.orderBy("poll_id").collect():
        found.setdefault(r["query"], []).append((r["poll_id"], r["mark_before"], r["mark_after"]))
    for q, polls in many.items():
        accepted, want = plain_take_while(polls, 100)
        assert got.get(q, set()) == set(accepted) and found[q] == want


def test_stream_stops_at_the_first_old_post_over_batches(spark, tmp_path):
    rng = random.Random(6)
    polls = {k: [(p, str(int(t) + 5)) for p, t in rows] for k, rows in unordered(rng, 4).items()}
    store = PostStore(spark, str(tmp_path / "store"))
    store.create(feeds(spark))
    meta = metadata(spark, [p for rows in polls.values() for p, _ in rows])
    whole = listing(spark, polls)
    for n, part in enumerate([whole.where("poll_id = 0 AND page = 0"), whole.where("(poll_id = 0 AND page > 0) OR poll_id = 1"), whole.where("poll_id > 1")]):
        ingest_batch(store, part, n, meta, clock(), prefix=True)
    accepted, marks = plain_take_while(polls, 100)
    assert ids(store.posts()) == sorted(p for _, p in accepted)
    assert store.feeds().first()["last_post_time"] == marks[-1][2]


def test_first_listed_keeps_bounded_state(spark, tmp_path):
    base = str(tmp_path)
    for polls in ({0: [("a", "1000"), ("b", "990"), ("a", "980")]}, {1: [("b", "2000"), ("c", "1990")]}, {2: [("d", "900000"), ("x", "bad")]}, {3: [("a", "900001"), ("d", "900002")]}):
        listing(spark, polls).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = first_listed(stream_listing(spark, f"{base}/in", files_per_trigger=1), "1 hour")
        query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/c")
        query.trigger(availableNow=True).start().awaitTermination()
    # a and d come again: a long after the horizon, so it passes once more
    assert ids(spark.read.schema(S.LISTING).parquet(f"{base}/out")) == ["a", "a", "b", "c", "d"]
