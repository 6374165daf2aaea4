"""Hot keys, clashing names and bounds of the operators: nothing is cut, whatever shares a word, an id or a name."""

import pytest
from brute import benchmark_hits
from pyspark.sql import functions as F

import corpus_pipeline
from feedwatch.llm import decontamination, mixing, personal_data, quality_classifier, toxicity


def test_windows_that_share_their_rarest_word_and_a_passage_of_many_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SLICE", 8)
    template = "this passage stands in every item of the benchmark as it is"
    items = [(i, f"{template} item {i} rare tail {'a b ' * (i % 3)}x{i % 5}") for i in range(40)]
    # every document holds the word rare once, so it is the rarest word of many windows
    texts = [f"{template} item {i} rare tail {'a b ' * (i % 3)}x{i % 5} and more item item item tail tail" for i in range(0, 60, 3)]
    texts += [f"{template} but no item", "rare", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(found) == len(texts)
    for r in found:
        n, hit, ids = benchmark_hits(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["item_list"]) == (n, hit, sorted(map(str, ids)))


def test_rows_without_an_id_are_spread_over_the_shards(spark):
    rows = [(None, f"{i} {'w ' * 10}", "a") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(mixing.sizes(docs), shard_words=1000)
    shards = {r["shard"]: r["count"] for r in mixed.groupBy("shard").count().collect()}
    assert len(shards) == 12 and max(shards.values()) < 200


@pytest.mark.parametrize(
    "text, at, word",
    [("", 0, ""), ("phone 5", 6, "phone"), (f"phone{' ' * 5000}5", 5005, "phone"), (f"a {'x' * 5000} 5", 5003, "x" * 5000), ("5", 0, ""), (" 5", 1, "")],
)
def test_the_word_before_is_found_whole_however_far(text, at, word):
    assert personal_data.word_before(text, at) == word


def test_shapes_of_long_words_differ_where_the_words_do():
    assert personal_data.shape("12-ab-3") == "9-a-9"
    assert personal_data.shape("1-" * 40 + "a") != personal_data.shape("1-" * 40 + "_")


def test_only_shapes_are_bounded(spark):
    texts = [f"mail a{i}@b.org host 1.2.3.4 call +1 555 010 {i:04d} {'-' * (i % 7)}{i}{'_' * (i % 11)}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole, bounded = personal_data.train(docs), personal_data.train(docs, shapes=2)
    shapes = [{n for n in field.word if n.startswith("shape ")} for field in (whole, bounded)]
    assert len(shapes[0]) > 20 and len(shapes[1]) == 2
    assert set(whole.word) - shapes[0] == set(bounded.word) - shapes[1]
    assert (whole.prior == bounded.prior).all() and all((whole.edge[k] == bounded.edge[k]).all() for k in whole.edge)


def test_one_text_in_all_rows_is_sampled_row_by_row(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("host 1.2.3.4").alias("text"))
    chosen = personal_data.sampled(docs, "text", 1000, "doc_id").count()
    assert 850 < chosen < 1150


def test_training_reads_no_column_but_its_own(spark):
    docs = spark.createDataFrame([(i, f"word{i % 2} text", 7, "x") for i in range(40)], "doc_id long, text string, __id long, __label string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert quality_classifier.labelled(docs, labels, "doc_id", "toxic", 100).count() == 40
    assert toxicity.train(docs, labels, "doc_id", "toxic") is not None


CLASHING = "doc_id long, source string, lang string, n_chars long, text string, __key string, key string, row string, order string"


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(12))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, "s", "en", 9, f"text {i} of some {i} own words {i} here", f"k{i}", "u", "v", "w") for i in range(5)]
    rows.append((9, "s", "en", 9, item, "hit", "u", "v", "w"))
    docs = spark.createDataFrame(rows, CLASHING)
    firsts = corpus_pipeline.without_copies(spark, docs, str(tmp_path))
    assert firsts.schema.names == docs.schema.names and sorted(firsts.collect()) == sorted(docs.collect())
    clean = corpus_pipeline.without_benchmark(spark, docs, str(tmp_path))
    assert sorted(clean.collect()) == sorted(docs.where("doc_id < 9").collect())


def test_of_rows_alike_in_id_and_text_the_least_stays(spark, tmp_path):
    text = "a text that stands in several rows under one id"
    rows = [(1, s, "en", 9, text, k, "u", "v", "w") for s, k in [("b", "x"), ("a", "y"), ("a", "x"), ("c", None)]]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, CLASHING).repartition(parts)
        kept = corpus_pipeline.without_copies(spark, docs, str(tmp_path)).collect()
        assert [(r["source"], r["__key"]) for r in kept] == [("a", "x")]
