"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import brute
import pytest
from pyspark.sql import functions as F

from feedwatch.llm import (
    decontamination,
    jaccard_join,
    katz,
    mixing,
    personal_data,
    quality_classifier,
    quality_rules,
    token_counts,
    toxicity,
    url_filter,
)

N = len(brute.edge_rows())


@pytest.fixture(scope="module")
def docs(spark):
    return brute.edge_docs(spark)


@pytest.fixture(scope="module")
def none(spark):
    return brute.empty_docs(spark)


def test_quality_rules(docs, none):
    rows = quality_rules.judge(quality_rules.document_figures(docs))[0].collect()
    assert len(rows) == N
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 20)
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_words"] == by[1]["n_words"] == 0 and by[7]["n_words"] == by[7]["n_repeat_words"] == 30_000
    judged, model = quality_rules.judge(quality_rules.document_figures(none))
    assert judged.count() == 0 and 0 < model.good < 1


def test_mixing(docs, none):
    rows = mixing.mix(mixing.sizes(docs)).collect()
    assert len(rows) == N and {r["source"] for r in rows} == {None, "s"}
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - total) <= 64
    assert mixing.mix(mixing.sizes(none)).count() == 0


def test_jaccard_join(docs, none):
    rows = jaccard_join.jaccard_classes(docs).collect()
    assert len(rows) == N
    found = [(r["doc_id"], r["class_id"], r["n_links"]) for r in rows]
    assert (5, 5, 1) in found and (9, 5, 1) in found
    assert found.count((3, 3, 2)) == 3
    assert (0, 0, 0) in found and (1, 1, 0) in found and (2, 2, 0) in found and found.count((None, None, 0)) == 2
    assert jaccard_join.jaccard_classes(none).count() == 0


def test_url_filter(spark, none):
    model = url_filter.train(url_filter.labelled_urls(spark))
    urls = [(1, None, "x"), (2, "", "x"), (3, "no scheme", "x"), (4, "x://" + "a" * 50_000 + "/p", "x"), (4, "x://a.net/es/", "x"), (4, "x://a.net/es/", "x")]
    rows = url_filter.judge(spark.createDataFrame(urls, "page_id long, url string, rule string"), model).collect()
    assert len(rows) == 6 and [(r["host"], r["path"]) for r in rows[:3]] == [("", "")] * 3
    assert [r["rule"] for r in rows[4:]] == ["net/es/"] * 2
    assert url_filter.judge(none.select("doc_id", F.col("text").alias("url")), model).count() == 0


def test_quality_classifier(docs, none):
    model = quality_classifier.train(docs.limit(0).withColumn("__label", F.lit(1)))
    assert {r["score"] for r in quality_classifier.score(docs.select("doc_id", "text"), model).collect()} == {0.5}
    labelled = docs.where("doc_id IS NOT NULL").withColumn("__label", (F.col("doc_id") % 2).cast("int"))
    scored = quality_classifier.score(docs.select("doc_id", "text"), quality_classifier.train(labelled)).collect()
    assert len(scored) == N and all(0 <= r["score"] <= 1 for r in scored)
    assert quality_classifier.score(none.select("doc_id", "text"), model).count() == 0


def test_token_counts(docs, none):
    path = token_counts.vocabulary_path()
    rows = token_counts.token_counts(docs, path).collect()
    assert len(rows) == N and all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (0, 1))
    assert token_counts.token_counts(none, path).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame(
        [(1, "same text here again please same text here again please same"), (1, "same text here again please same text here again please same"), (None, "one two three four"), (2, None), (3, ""), (4, "a")],
        "item_id long, text string",
    )
    rows = decontamination.contaminated(docs, items).collect()
    assert len(rows) == N
    by = {r["doc_id"]: r for r in rows}
    assert by[5]["n_hit"] == by[5]["n_words"] == 150 and by[5]["item_list"] == ["1"]
    assert by[4]["n_hit"] == 4 and by[4]["n_items"] == 0
    assert by[3]["item_list"] == ["4"] and by[0]["n_words"] == 0
    assert decontamination.contaminated(none, items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_personal_data(docs, none):
    field = personal_data.train(docs)
    rows = personal_data.personal_data(docs.select("doc_id", "text"), field).collect()
    assert len(rows) == N
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["base"] == [] and by[0]["redacted"] is None and len(by[8]["base"]) == 80
    assert "@" not in by[8]["redacted"] and by[6]["redacted"] == "x" * 30_000
    assert personal_data.personal_data(none.select("doc_id", "text"), personal_data.train(none)).count() == 0


def test_katz(docs, none):
    rows = katz.katz_scores(docs, F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 0).collect()
    assert len(rows) == N
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (0, 1, 2))
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    assert katz.katz_scores(none, F.lit(True)).count() == 0
    untaught = katz.katz_scores(docs, F.lit(False)).collect()
    assert all(r["score"] == 0 and abs(r["base_score"]) < 1e-6 for r in untaught)


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(None, 1), (4, 7), (5, None)], "doc_id long, toxic int")
    net = toxicity.train(docs, labels, "doc_id", "toxic")
    rows = toxicity.score(docs.select("doc_id", "text"), net).collect()
    assert len(rows) == N and all(0 <= r["score"] <= 1 for r in rows)
    untaught = toxicity.train(docs, labels.limit(0), "doc_id", "toxic")
    assert all(r["score"] < 0.01 for r in toxicity.score(docs.select("doc_id", "text"), untaught).collect())
    assert toxicity.score(none.select("doc_id", "text"), untaught).count() == 0
