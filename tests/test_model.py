import pytest
from pyspark.sql import functions as F

from feedwatch.operators import features, labelling, model, stats
from feedwatch.sources import schemas as S
from feedwatch.sources import tables
from feedwatch.streaming.route import start_classifier


def posts(spark, rows):
    """rows: (post_id, title, description, notify)"""
    full = [
        ("gallery", i, ("u", "ann", "regular"), t, d, "", True, [("art", False, "")], False, f"https://x/{i}", n, 0)
        for i, t, d, n in rows
    ]
    return spark.createDataFrame(full, S.POST)


def toy(spark, n=60):
    rows = [
        (str(i), f"{'open now' if i % 2 else 'closed today'} item{i % 5}", f"<p>word {i % 7} slot{i % 3}</p>", bool(i % 2))
        for i in range(n)
    ]
    rows += [(f"u{i}", "open now" if i % 2 else "closed today", "word", None) for i in range(10)]
    return posts(spark, rows)


@pytest.fixture(scope="module")
def fitted(spark):
    return model.train(toy(spark), max_iter=30)


def test_separable_set_is_learned(spark, fitted):
    rows = fitted.score(toy(spark)).collect()
    assert fitted.reason is None and fitted.calibration.slope > 0
    assert all(0.0 <= r["score"] <= 1.0 for r in rows)
    assert all(r["would_notify"] == r["notify"] for r in rows if r["notify"] is not None)


def test_reference_direction_and_cutoff(spark, fitted):
    positive = {r["post_id"]: r["score"] for r in fitted.score(toy(spark)).collect()}
    other = fitted.score(toy(spark), notify_cutoff=0.0, score_class="negative").collect()
    assert all(r["would_notify"] for r in other)
    assert all(abs(positive[r["post_id"]] + r["score"] - 1) < 1e-9 for r in other)


def test_saved_model_scores_the_same(spark, fitted, tmp_path):
    fitted.save(str(tmp_path), 3)
    loaded = model.NotificationModel.load(str(tmp_path), 3)
    a = {r["post_id"]: r["score"] for r in fitted.score(toy(spark)).collect()}
    b = {r["post_id"]: r["score"] for r in loaded.score(toy(spark)).collect()}
    assert a == pytest.approx(b)


@pytest.mark.parametrize(
    "labelled, described, positive, reason",
    [
        (19, 19, 9, "not_enough_labelled"),
        (20, 9, 9, "not_enough_descriptions"),
        (20, 10, 9, None),
        (20, 20, 20, "single_class"),
        (0, 0, 0, "not_enough_labelled"),
    ],
)
def test_training_guard(spark, labelled, described, positive, reason):
    rows = [(str(i), "t", "d" if i < described else "", i < positive) for i in range(labelled)]
    rows.append(("u", "t", "d", None))
    guard = model.training_guard(posts(spark, rows)).first()
    assert guard["reason"] == reason and guard["ok"] == (reason is None)


def test_fallback_model(spark):
    few = posts(spark, [(str(i), "t", "d", None) for i in range(30)])
    fallback = model.train(few)
    assert fallback.reason == "not_enough_labelled"
    assert {r["score"] for r in fallback.score(few).collect()} == {1.0}
    assert fallback.select_to_label(few, 5).count() == 5


def test_retrain_goes_on_after_a_site_without_data(spark, tmp_path):
    result = model.retrain(toy(spark), str(tmp_path), 1, ["microblog", "gallery"])
    rows = {r["site"]: (r["success"], r["error"]) for r in result.collect()}
    assert rows == {"microblog": (False, "not_enough_labelled"), "gallery": (True, None)}
    assert model.NotificationModel.load(f"{tmp_path}/site=gallery", 1).reason is None


def test_retrain_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    def train(posts, site):
        if site == "microblog":
            raise ValueError("no such folder")
        return model.NotificationModel(site, "single_class")

    monkeypatch.setattr(model, "train", train)
    rows = model.retrain(toy(spark), str(tmp_path), 1, ["microblog", "gallery"]).collect()
    assert [tuple(r) for r in rows] == [("microblog", False, "no such folder"), ("gallery", False, "single_class")]


def test_class_weights_are_balanced(spark):
    rows = model.class_weights(posts(spark, [(str(i), "t", "d", i < 3) for i in range(12)])).collect()
    assert {r["notify"]: r["weight"] for r in rows} == {True: 2.0, False: 12 / 18}


def test_vectors_equal_long_form_weights(spark):
    frame = features.with_terms(tables.select_posts(toy(spark), labelled=True))
    n = frame.count()
    fitted = features.fit_features(frame, n)
    counts = features.term_counts(frame)
    long = features.tfidf(counts, features.vocabulary(counts, n), n)
    want = {
        r["post_id"]: sorted(round(w, 9) for w in r["w"])
        for r in long.groupBy("post_id").agg(F.collect_list("weight").alias("w")).collect()
    }
    for row in fitted.transform(frame).collect():
        assert sorted(round(float(v), 9) for v in row["features"].values if v) == want[row["post_id"]]


def test_training_rows_have_a_documented_bound(spark):
    fitted = model.train(toy(spark), max_labelled_rows=1)
    assert fitted.reason == "not_enough_labelled"


def test_scoring_reads_posts_once_and_joins_nothing(spark):
    plan = model.train(toy(spark)).score(toy(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_selection_without_randomness_is_the_top_k(spark):
    scored = spark.createDataFrame([("gallery", str(i), i / 50) for i in range(50)], "site string, post_id string, score double")
    chosen = labelling.select_to_label(scored, 7, ratio=0.0).orderBy("slot").collect()
    top = labelling.nearest_to_decision(scored, 7).collect()
    assert [r["post_id"] for r in chosen] == [r["post_id"] for r in top]
    everything = labelling.select_to_label(scored, 7, ratio=1.0)
    assert everything.where("randomised").count() == 7
    assert labelling.select_to_label(scored, 500).count() == 50


def test_missing_selected_posts_are_reported(spark):
    selected = spark.createDataFrame([(1, "gallery", "0", False), (2, "gallery", "gone", False), (3, "microblog", "0", False)], "slot int, site string, post_id string, randomised boolean")
    found, missing = labelling.find_selected(selected, toy(spark))
    assert [r["post_id"] for r in found.collect()] == ["0"]
    assert sorted((r["site"], r["post_id"]) for r in missing.collect()) == [("gallery", "gone"), ("microblog", "0")]


def test_statistics_of_no_posts(spark):
    none = posts(spark, [("a", "t", "d", None)]).where("post_id = 'b'")
    row = stats.corpus_stats(none).first()
    assert row["post_count"] == 0 and row["notification_rate"] is None
    assert "nan%" in stats.statistics_report(none).where("line_no = 1").first()["line"]


def test_a_stream_of_posts_is_scored_by_the_model(spark, tmp_path):
    fitted = model.train(toy(spark))
    landed = toy(spark).withColumn("set_notify", F.lit(None).cast("boolean")).withColumn("skip_write", F.lit(False))
    landed.write.parquet(str(tmp_path / "landing"))
    stream = spark.readStream.schema(landed.schema).parquet(str(tmp_path / "landing"))
    out = str(tmp_path / "out")
    start_classifier(stream, fitted, out, str(tmp_path / "checkpoint"), threshold=0.5).awaitTermination()
    got = {r["post_id"]: round(r["score"], 9) for r in spark.read.parquet(out).collect()}
    want = {r["post_id"]: round(r["score"], 9) for r in fitted.score(toy(spark)).where("score > 0.5").collect()}
    assert got == want and want
