"""The registered queries against SQL, brute force or held-out labels."""

import itertools
import math
import os
import random
import sys

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import difference, oracle  # noqa: E402
from conftest import SF  # noqa: E402

import corpus_pipeline  # noqa: E402
from feedwatch.llm import decontamination, jaccard_join, katz, mixing, personal_data, quality_rules, registry, token_counts, toxicity, url_filter  # noqa: E402
from feedwatch.llm.common import table  # noqa: E402

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def items(spark):
    return [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert len(got) and difference(got, oracle(SF).execute(SQL[name]).fetchdf()) is None


def test_there_is_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))


def test_quality_rules_figures_and_verdicts(spark, texts):
    rows = {r["doc_id"]: r for r in registry.queries()["op1_quality_rules"](spark, SF).collect()}
    for doc_id, text in texts:
        words = brute.WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), brute.repeated_words(words))
        assert tuple(rows[doc_id][c] for c in quality_rules.FIGURES) == want
        assert rows[doc_id]["base_failed"] == (len(words) < 20 or 100 * want[4] > 30 * len(words))
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    judged = [(rows[i]["kept"], labels[i] == 1) for i in labels if not rows[i]["base_failed"]]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)


def test_em_finds_the_accuracies_that_made_the_votes():
    rng = np.random.default_rng(0)
    good, right = rng.random(20_000) < 0.8, np.array([0.95, 0.9, 0.8, 0.7])
    votes = np.where(rng.random((20_000, 4)) < right, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    votes[rng.random((20_000, 4)) < 0.3] = 0
    kinds, times = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.fit(kinds, times.astype(float))
    assert abs(model.good - 0.8) < 0.03 and np.abs(np.array(model.accuracy()) - right).max() < 0.05


def test_repeated_words_equal_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        words = [rng.choice("abc") for _ in range(rng.randrange(0, 60))]
        assert quality_rules.repeated_words(words) == brute.repeated_words(words)


def test_mix_meets_targets(spark):
    rows = registry.queries()["op2_mixing"](spark, SF).toPandas()
    assert (rows["taken"] <= 3 * rows["size"]).all() and rows["size"].sum() == pytest.approx(rows["target"].groupby(rows["source_size"]).first().sum(), rel=0.01)
    by = rows.groupby("target")["taken"].sum()
    assert all(abs(taken - target) <= mixing.BLOCK_WORDS for target, taken in by.items() if rows.loc[rows["target"] == target, "source_size"].nunique() == 1)


def test_apportionment_equals_the_highest_quotients_one_by_one(spark):
    rng = random.Random(2)
    for seats in (0, 1, 7, 40):
        values = [rng.randrange(0, 100) for _ in range(9)]
        given = [0] * 9
        for _ in range(seats):
            best = max(range(9), key=lambda i: (values[i] / (2 * given[i] + 1), -i))
            given[best] += 1
        df = spark.createDataFrame([("g", i, v, seats) for i, v in enumerate(values)], "g string, i int, v long, s long")
        got = {r["i"]: r["quota"] for r in mixing.apportion(df, ["g"], ["i"], "v", "s").collect()}
        assert [got[i] for i in range(9)] == given


def test_jaccard_classes_equal_brute_force(spark, texts):
    want = brute.jaccard_classes(texts)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in registry.queries()["op3_jaccard_join"](spark, SF).collect()}
    assert got == want


def test_a_large_group_of_near_copies_is_verified_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 8)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base[:k] + ["new"] + base[k:])) for k in range(40)] + [(100 + k, " ".join(f"v{k}-{i}" for i in range(30))) for k in range(5)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.jaccard_classes(rows)


def test_prefixes_shorten_until_the_recall_is_met():
    assert jaccard_join.forest(recall=0.5)[1] > jaccard_join.forest(recall=0.9999)[1]
    for threshold in (0.95, 0.8, 0.5, 0.3, 0.1):
        tries, depth = jaccard_join.forest(threshold)
        assert jaccard_join.reached(threshold, depth, tries) >= jaccard_join.RECALL
        assert depth == jaccard_join.DEPTH or jaccard_join.reached(threshold, depth + 1, tries) < jaccard_join.RECALL
    assert jaccard_join.forest(0.3)[0] > jaccard_join.TRIES
    with pytest.raises(ValueError, match="tries"):
        jaccard_join.forest(0.01)


def test_neighbours_are_linked_as_prefix_groups_are(spark):
    """Chains of neighbours over many ranges join the same nodes as groups of equal prefixes do."""
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 3, (400, 3, jaccard_join.DEPTH)).astype(">u2")
    rows = [(i.to_bytes(16), [x.tobytes() for x in label]) for i, label in enumerate(labels)]
    nodes = spark.createDataFrame(rows, "node binary, labels array<binary>").repartition(7)
    for depth in (jaccard_join.DEPTH, 4, 2):
        edges = [(int.from_bytes(r["a"]), int.from_bytes(r["b"])) for r in jaccard_join.candidate_edges(nodes, depth).collect()]
        assert all((labels[a, :, :depth] == labels[b, :, :depth]).all(axis=1).any() for a, b in edges)
        groups = {}
        for i, label in enumerate(labels):
            for t in range(3):
                groups.setdefault((t, label[t, :depth].tobytes()), []).append(i)
        want = [(i, g[0]) for g in groups.values() for i in g[1:]]
        assert brute.partition(range(400), edges) == brute.partition(range(400), want)


@pytest.mark.parametrize("threshold", [0.8, 0.3])
def test_recall_of_links_at_a_threshold(spark, threshold):
    """Pairs of texts at or just above the threshold, found as brute force finds them."""
    rng = random.Random(11)
    rows = []
    for pair in range(150):
        words = [f"w{pair}x{rng.randrange(10**6)}" for _ in range(60)]
        other = words[: round(2 * threshold / (1 + threshold) * 56) + 5] + [f"v{pair}x{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other[:60]))]
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold).collect()}
    sets = {i: brute.shingles(t) for i, t in rows}
    want = {i: int(len(sets[i] & sets[i ^ 1]) >= threshold * len(sets[i] | sets[i ^ 1])) for i in sets}
    assert sum(want.values()) > 250 and got == want


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://WWW.Example.com/en/x?y", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://a.example.com/en/x#y", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("http://a.example.com/EN/x", "a.example.com", "/EN/x", "com/", "allow"),
        ("ftp://a.net/es/1://2", "a.net", "/es/1://2", "net/es/", "block"),
        ("http://b.net/fr/", "b.net", "/fr/", "net/fr/", "block"),
        ("http://free-bets.example.net/en/5", "free-bets.example.net", "/en/5", None, "block"),
        ("http://casino-win.example.org", "casino-win.example.org", "", None, "block"),
        ("http://city-library.example.org/de/7.html", "city-library.example.org", "/de/7.html", None, "allow"),
        ("http://com", "com", "", None, "allow"),
        ("http://xcom/", "xcom", "/", None, "allow"),
    ],
)
def test_url_verdicts(spark, url_model, url, host, path, rule, verdict):
    row = url_filter.judge(spark.createDataFrame([(1, url)], "page_id long, url string"), url_model).first()
    assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, rule, verdict)


@pytest.fixture(scope="module")
def url_model(spark):
    return url_filter.train(url_filter.labelled_urls(spark))


def test_url_table_is_not_read_off_the_pages(spark):
    labelled = url_filter.labelled_urls(spark)
    hosts = {r["host"] for r in table(spark, SF.replace("0.001", "0.1"), "pages").select(url_filter.split_url(F.col("url"))[0].alias("host")).distinct().collect()}
    labels = {part for h in hosts for part in h.split(".")} - {"www", "m", "blog", "example", "com", "net", "org"}
    names = {r["name"] for r in labelled.select("name").distinct().collect()}
    assert labels and not names & labels
    assert not names & {"thing", "ther", "tion", "ing", "station", "theory", "either"}


def test_urls_of_names_left_out_of_training_are_judged(spark):
    figures = url_filter.held_out_figures(url_filter.labelled_urls(spark))
    assert figures["urls"] == url_filter.labelled_urls(spark).count()
    assert figures["precision"] > 0.75 and figures["recall"] > 0.3


def test_url_table_is_an_argument(spark, tmp_path):
    (tmp_path / "sites.csv").write_text("name,label,topic\nzebra-qq,1,x\nplain-vv,0,x\n")
    rows = url_filter.labelled_urls(spark, tmp_path / "sites.csv")
    assert {(r["name"], r["label"]) for r in rows.collect()} == {("zebra-qq", 1), ("plain-vv", 0)}
    urls = spark.createDataFrame([("http://my-zebra-qq.info",), ("http://my-plain-vv.info",)], "url string")
    assert [r["verdict"] for r in url_filter.judge(urls, url_filter.train(rows)).collect()] == ["block", "allow"]


def test_url_scores_equal_the_regression_by_hand(spark, url_model):
    urls = table(spark, SF, "pages").select("page_id", "url").limit(20)
    host, path = url_filter.split_url(F.col("url"))
    hashed = url_filter.hashing().transform(urls.select("page_id", url_filter.grams(host, path).alias("__grams")))
    weights = url_model.coefficients.toArray()
    got = {r["page_id"]: r["score"] for r in url_filter.judge(urls, url_model).collect()}
    for r in hashed.collect():
        margin = weights[r["__features"].indices].sum() + url_model.intercept
        assert got[r["page_id"]] == pytest.approx(1 / (1 + math.exp(-margin)))


@pytest.mark.parametrize("name, label, held_out", [("op5_quality_classifier", "quality", (5, 0)), ("op10_toxicity", "toxic", (4, 2))])
def test_classifiers_rank_held_out_rows(spark, name, label, held_out):
    sf = SF.replace("0.001", "0.01")
    rows = registry.queries()[name](spark, sf).collect()
    labels = {r["doc_id"]: r[label] for r in table(spark, sf, "labels").collect()}
    assert all(r["held_out"] == (brute.fold(r["doc_id"], held_out[0]) == held_out[1]) for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    scores = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    pairs = [(a > b) + (a == b) / 2 for a, x in scores for b, y in scores if x > y]
    assert sum(pairs) / len(pairs) > 0.85


def test_tokens_equal_the_library(spark, texts):
    model = token_counts.load(token_counts.vocabulary_path())
    odd = ["a  b\n c ", " a", "\n", "a\n\nb", "<s> x </s> <unk>", "▁a ▁▁b", "a\x00b", "x\t\ty\r\nz \r", " " * 40 + "x", "①ﬁ", "\n \n"]
    rows = [*texts, *enumerate(odd, 10**6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(df, token_counts.vocabulary_path()).collect()}
    assert got == {i: (len(t.encode()), len(model.encode(t))) for i, t in rows}


def test_whole_tokens_are_proved_one_by_one():
    model = token_counts.load(token_counts.vocabulary_path())
    whole = token_counts.proof(model)
    assert len(whole) > 30_000 and all(len(model.encode("\n" + p)) == 3 for p in sorted(whole)[:500])


def test_decontamination_equals_brute_force(spark, texts, items):
    rows = {r["doc_id"]: r for r in decontamination.contaminated(table(spark, SF, "documents"), table(spark, SF, "benchmark")).collect()}
    for doc_id, text in texts:
        n, hit, found = brute.benchmark_hits(text, items)
        r = rows[doc_id]
        assert (r["n_words"], r["n_hit"], r["item_list"]) == (n, hit, sorted(map(str, found)))


def test_decontamination_in_slices_is_the_same(spark, monkeypatch):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    whole = sorted(map(str, decontamination.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontamination, "SLICE", 300)
    assert sorted(map(str, decontamination.contaminated(docs, items).collect())) == whole


def test_base_spans_equal_the_patterns(texts):
    odd = ["1.2.3.4.5.6.7.8 300.1.1.1 @a.b x@y a@b.c@d.e", "4111-1111 1111 1111 4111111111111112", "+1 (2) 3456789 +12 3 + 4", "a..b@c..d %+-@x.y", "1.2.3 1.2.3.4.", "+123456789+987654321"]
    for text in [*odd, *[t for _, t in texts if t]]:
        assert personal_data.base_spans(text) == brute.base_spans(text)


def test_address_with_thousands_of_leading_zeros(spark):
    text = "0" * 5000 + ".1.1.1 and " + "0" * 5000 + "256.1.1.1"
    assert personal_data.base_spans(text) == [("ip", 0, 5006)]
    field = personal_data.train(table(spark, SF, "documents"))
    assert personal_data.find(text, field)[0] == [("ip", 0, 5006)]
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert personal_data.personal_data(rows, field).first()["redacted"] is not None


def test_skip_edges_carry_a_label_to_where_no_pattern_matches(spark):
    field = personal_data.train(table(spark, SF, "documents"))
    text = "call +1 (988) 555-2485 today. Then again (988) 555-2485, not 12 or 2024."
    base, added = personal_data.find(text, field)
    assert [text[a:b] for _, a, b in base] == ["+1 (988) 555-2485"]
    assert [(k, text[a:b]) for k, a, b in added] == [("phone", "988) 555-2485")]
    assert personal_data.find("12 of 4111111111111112 and 2024 and 2024 (988) 555-2485", field) == ([], [])


@pytest.mark.parametrize("repeats", [1, 9, 50, 1000])
def test_a_number_is_marked_wherever_it_is_repeated(spark, repeats):
    field = personal_data.train(table(spark, SF, "documents"))
    for first, again in (("call +9885552485 today. ", "9885552485"), ("host 10.20.30.40 up. ", "10-20-30-40")):
        for text in (first + f"Then again {again} for us. " * repeats, f"Then again {again} for us. " * repeats + first):
            base, added = personal_data.find(text, field)
            assert len(base) == 1 and len(added) == repeats
            assert {(k, text[a:b]) for k, a, b in added} == {(base[0][0], again)}


def test_messages_settle_on_the_exact_marginals_of_a_chain(spark):
    field = personal_data.train(table(spark, SF, "documents"))
    g = personal_data.Graph("tel 555-2485 " + "and 5552485 " * 5, [])
    unary, labels = field.unary(g), range(len(personal_data.LABELS))
    exact = np.zeros_like(unary)
    for ys in itertools.product(labels, repeat=len(g.words)):
        weight = np.exp(sum(unary[k, y] for k, y in enumerate(ys)) + sum(field.edge["skip"][ys[i], ys[j]] for i, j in g.skip))
        for k, y in enumerate(ys):
            exact[k, y] += weight
    assert not g.near and len(g.skip) == 5
    assert np.abs(field.marginals(g) - exact / exact.sum(axis=1, keepdims=True)).max() < 1e-6


@pytest.mark.parametrize("hot", [None, 20])
def test_katz_scores_equal_brute_force(spark, texts, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(katz, "HOT_LEAST", hot)
        monkeypatch.setattr(katz, "BLOCK_TOKENS", 5000)
    want, total = brute.katz(texts, lambda i: brute.fold(i, 5) != 1, katz.discounts, katz.K, katz.TAIL)
    assert max(abs(t - 1) for t in total.values()) < 1e-9
    got = {r["doc_id"]: r for r in registry.queries()["op9_katz"](spark, SF).collect()}
    for i, (doc_id, _) in enumerate(texts):
        r = got[doc_id]
        assert (r["n_tokens"], r["n_known"]) == want[i][:2]
        assert r["base_score"] == pytest.approx(want[i][2]) and r["score"] == pytest.approx(want[i][3])


def test_toxicity_threshold_belongs_to_the_language():
    tokens = toxicity.Tokens()
    assert [toxicity.LANGUAGES[tokens.read(t)[1]] for t in ("the cat of it", "der Hund und ich", "le chat et les", "el gato y los", None, "zzz")] == ["en", "de", "fr", "es", "other", "other"]
    assert toxicity.best_threshold(np.array([3.0, 2.0, 1.0, 0.0]), np.array([1, 1, 0, 0]), np.ones(4)) == 1.5


def test_pipeline_stages_do_what_they_say(spark, items):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SF)
        after = docs.collect()
        kept = {r["doc_id"]: r for r in after}
        assert len(after) == len(kept) <= len(before)
        if name != "mixing sources":
            assert docs.columns == table(spark, SF, "documents").columns
            docs = spark.createDataFrame(after, docs.schema)
        if name == "n-gram Jaccard join":
            classes = brute.jaccard_classes([(r["doc_id"], r["text"]) for r in before])
            assert set(kept) == {c for c, _ in classes.values()}
        if name == "benchmark decontamination":
            assert set(kept) == {r["doc_id"] for r in before if not brute.benchmark_hits(r["text"], items)[1]}
        if name == "personal data":
            assert set(kept) == {r["doc_id"] for r in before}
            for r in before:
                if not brute.base_spans(r["text"] or ""):
                    assert kept[r["doc_id"]]["text"] == r["text"]
                assert not brute.base_spans(kept[r["doc_id"]]["text"])
        if name == "mixing sources":
            assert all(0 < r["taken"] <= 3 * r["size"] for r in after)


def test_rows_without_a_word_are_copies_of_nothing(spark):
    texts = [None, None, "", "", " \n", " \n", "two words", "two words"]
    rows = [(i, t, None, s, None) for i in (None, 7) for s in ("a", "b") for t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = [tuple(r) for r in corpus_pipeline.without_copies(spark, docs, SF).collect()]
    wordless = [r for r in rows if r[1] != "two words"]
    assert sorted((r for r in left if r[1] != "two words"), key=str) == sorted(wordless, key=str)
    assert [r[:2] for r in left if r[1] == "two words"] == [(7, "two words")]


def test_pipeline_handles_awkward_rows(spark):
    docs = brute.edge_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), brute.SCHEMA)
        assert docs.count() > 0, name
    empty = brute.empty_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
