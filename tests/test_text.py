import random
import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedwatch.functions import formats, text
from feedwatch.plans import base_sql
from feedwatch.plans.base_sql import quote


def _one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("a<br>b", "ab"),
        ("x<script>if (a<b) {}</script>y<style>p{}</style>z<!-- c -->", "xyz"),
        ("&amp;lt;", "&lt;"),
        ("&copy; &#65;&#x42; &#150; &nosuch; &", "© AB – &nosuch; &"),
        ("3 < 4 and 5 > 2", "3 < 4 and 5 > 2"),
        ("<a title=\"1 > 0\" rel='x>y'>b</a>c", "bc"),
        ("<a t = \"x>\" u=v\"w>b", "b"),
        ("<p it's>a</p>", "a"),
        ("<p class=a=\">\">b", "\">b"),
        ("<a\nx=\"\n>\">b</a\n>c", "bc"),
        ("<SCRIPT src=\"</script>\">a</script >b", "b"),
        ("<scripty>a</scripty>b", "ab"),
        ("a<script>b", "a"),
        ("a<!-- b --!>c<!-->d<!--->e<!-- f", "acde"),
        ("<!doctype html><?xml a?></ x>b</>c", "bc"),
        ("a<b title=\"c>d", "a"),
        ("a <b", "a "),
        ("&copy 2020 &hellip. &copyright &notit; &notin; &AMP &#65b &#x42 &nosuch", "© 2020 …. ©right ¬it; ∉ & Ab B &nosuch"),
        ("", ""),
    ],
)
def test_strip_html(spark, html, expected):
    assert _one(spark, html, text.strip_html) == expected


def test_html_pattern_means_the_same_with_and_without_possessive_quantifiers(spark):
    """Random strings of HTML's signs, here and in the other regex engine, entities included."""
    rng = random.Random(7)
    parts = ["<", ">", "/", "!", "--", "=", '"', "'", " ", "\n", "a", "b=", "<a ", "</a", "<script", "</script>", "&amp", "&lt;", "&copyx;", "&#6", "5;"]
    made = ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(made)), "id long, html string")
    got = {r["id"]: r["r"] for r in rows.select("id", text.strip_html(F.col("html"), "|").alias("r")).collect()}
    con = duckdb.connect()
    con.register("pages", pa.table({"id": range(len(made)), "html": made}))
    sql = f"SELECT id, {base_sql.decode_entities_sql(base_sql.strip_html_sql('html', quote('|')))} AS r FROM pages"
    assert got == dict(con.execute(sql).fetchall())


@pytest.mark.parametrize("unit", ["<a ", '<a x="', "<a x=", "<script>", "<!--", "<a b='c' ", "</", "=", "<a x=y"])
def test_html_takes_time_linear_in_its_length(spark, unit):
    started = time.monotonic()
    assert _one(spark, unit * (400_000 // len(unit)), text.strip_html) is not None
    assert time.monotonic() - started < 20


def test_strip_html_separator(spark):
    assert _one(spark, "a<br>b", lambda c: text.strip_html(c, " ")) == "a b"


@pytest.mark.parametrize(
    "value, expected",
    [
        ("12 ½ 3.14 一二", ["$NUM$", "$NUM$", "3.14", "$NUM$"]),
        ("don't well-known", ["don't", "well-known"]),
        ("@ann #tag_1 a@b.co", ["@ann", "#tag_1", "a@b.co"]),
        ("see http://x.org/a?b=1, ok", ["see", "http://x.org/a?b=1", ",", "ok"]),
        (":-) <3 -->", [":-)", "<3", "-->"]),
        ("wait....... ======", ["wait", "...", "=", "=", "="]),
        ("1/2 10:30", ["1/2", "10:30"]),
        ("&lt;3", ["<3"]),
        ("", []),
    ],
)
def test_tokens(spark, value, expected):
    assert _one(spark, value, text.title_tokens) == expected


def test_description_tokens_lower_before_stripping(spark):
    assert _one(spark, "<B>Ten 10</B>", text.description_tokens) == ["ten", "$NUM$"]


def test_long_texts_do_not_exhaust_the_regex_stack(spark):
    for unit in ("a-", "a.b.", ". ", "<", "é'", "1/", "&amp;", "a@b.c."):
        tokens = _one(spark, unit * 20_000, text.description_tokens)
        assert tokens is not None


def test_stop_words_then_bigrams_bridge(spark):
    grams = _one(
        spark,
        "red the fox",
        lambda c: text.unigrams_and_bigrams(text.remove_stop_words(F.split(c, " "))),
    )
    assert grams == ["red", "fox", "red fox"]


def test_bigrams_of_short_texts(spark):
    split = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    assert _one(spark, "", lambda c: text.unigrams_and_bigrams(split(c))) == []
    assert _one(spark, "one", lambda c: text.unigrams_and_bigrams(split(c))) == ["one"]


def test_display_text(spark):
    assert _one(spark, "<p>a</p>\n\n<p>b &amp; c</p>", text.display_text) == "a\nb & c"


@pytest.mark.parametrize("value, expected", [("12", 12), ("-3", -3), ("1.5", None), ("x", None), ("", None)])
def test_parse_epoch(spark, value, expected):
    assert _one(spark, value, formats.parse_epoch) == expected


def test_two_decimals_ties_to_even(spark):
    df = spark.createDataFrame([(12.125,), (12.375,), (0.5,), (99.996,)], "v double")
    got = [r[0] for r in df.select(formats.two_decimals(F.col("v"))).collect()]
    assert got == [f"{v:.2f}" for v in (12.125, 12.375, 0.5, 99.996)]


def test_parse_callback(spark):
    row = _one(spark, "  cb_true gallery  77\n", formats.parse_callback)
    assert tuple(row) == ("cb_true", "gallery", "77")


def test_query_string_encodes_and_skips_null(spark):
    got = _one(
        spark, "a b&c", lambda c: formats.query_string({"q": c, "n": F.lit(None).cast("string")})
    )
    assert got == "q=a+b%26c"


def test_stop_words_are_sparks_list(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert text.default_stop_words() == tuple(sorted(set(StopWordsRemover.loadDefaultStopWords("english"))))
