"""Benchmark decontamination as a prefix-filtered set join.

Benchmark items become windows of ten consecutive words; an item of fewer words is one
window. Words are ordered by rarity, counted over all documents. A text holds a window
whole only if it holds the window's rarest word, so the necessary prefix is that one word:
document words join prefix words, the word's place in the window fixes where the window
would begin (positional bound), a window must fit into the text from there (length bound),
and the words there are then compared with all of the window's, in order.

The document's words stay an array beside the exploded position, so candidates are
compared in the task that made them, in generated code: the join needs no shuffle of text
and no second read. The window table goes to every executor in slices of at most
``SLICE`` windows, cut by a hash of the window, so that windows which share their rarest word
lie in different slices: a larger benchmark means more passes over the documents, and never
a larger broadcast. A slice holds a number for each window; the items of the windows found
are joined later, by document and number, so a passage of many items is broadcast once and
no longer than others. Rows that are shuffled are a row number and a span of words, or a window's
number. Hot passages spread by document. The text column is read twice for a benchmark of
one slice: once to count rarity, once to find the windows. Texts of any length are handled whole.

All is DataFrame functions. Nulls, empty texts and texts without a word have no words and no
hits; an item without a word has no window. Items with a null id make words hit, but are
not among the items listed. Repeated documents are judged one by one, repeated items are one
item. An empty benchmark hits nothing. Extra columns aren't read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

WINDOW = 10
#: Windows broadcast at a time: about 300 bytes each.
SLICE = 50_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_words(text: Column) -> Column:
    """Words in order: runs of lower-cased ASCII letters, digits and all beyond ASCII."""
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD, " ")
    return F.when(F.trim(plain) == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(plain), " "))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(item, window): every window of each item."""
    worded = items.select(F.col(item_id).cast("string").alias("item"), text_words(F.col(text)).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return worded.where(F.size("words") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("window"))


def numbered(windows: DataFrame) -> DataFrame:
    """(number, window) of each distinct window; write it before using the numbers twice."""
    return windows.select("window").distinct().withColumn("number", F.monotonically_increasing_id())


def sliced(df: DataFrame, rows: int, by: str) -> list[DataFrame]:
    """``df`` in parts of about half of ``rows`` rows at most, by a hash of column ``by``."""
    parts = 1 + 2 * df.count() // rows
    return [df] if parts < 3 else [df.where(F.pmod(F.xxhash64(by), F.lit(parts)) == k) for k in range(parts)]


def rarity(docs: DataFrame, text: str, made: DataFrame) -> DataFrame:
    """(word, times): how often each word of the windows occurs in all documents."""
    wanted = made.select(F.explode("window").alias("wanted")).distinct()
    words = docs.select(F.explode(text_words(F.col(text))).alias("word"))
    found = [
        words.join(F.broadcast(part), F.col("word") == F.col("wanted"), "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("times"))
        for part in sliced(wanted, SLICE * 4, "wanted")
    ]
    return reduce(DataFrame.unionAll, found)


def prefixes(made: DataFrame, times: DataFrame) -> DataFrame:
    """(number, window, prefix, place): each window's rarest word and its place, from 0.

    Windows with a word that no document holds can't be found and are left out.
    """
    placed = made.select("number", "window", F.posexplode("window").alias("place", "prefix"))
    order = Window.partitionBy("number").orderBy("times", "prefix", "place")
    counted = placed.join(times, F.col("prefix") == F.col("word"), "left").withColumn("rank", F.row_number().over(order))
    missing = F.max(F.col("times").isNull().cast("int")).over(Window.partitionBy("number"))
    return counted.withColumn("missing", missing).where("rank = 1 AND missing = 0").select("number", "window", "prefix", "place")


def found_windows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(row, n_words, begin, length, number) of every window found; and one row of length 0 for each document.

    ``docs`` has row and words. The empty word after the last one meets the one empty
    prefix of ``chosen``, so documents without a hit stay in the result.
    """
    each = docs.select("row", "words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("at", "word"))
    met = each.join(F.broadcast(chosen), F.col("word") == F.col("prefix"))
    begin = F.col("at") - F.col("place")
    met = met.withColumn("begin", begin).withColumn("length", F.size("window")).withColumn("n_words", F.size("words"))
    fits = (F.col("begin") >= 0) & (F.col("begin") + F.col("length") <= F.col("n_words"))
    # the first word rejects nearly all candidates before a slice is made
    ends = F.try_element_at("words", F.col("begin") + 1) == F.try_element_at("window", F.lit(1))
    same = ends & (F.slice("words", F.col("begin") + 1, F.col("length")) == F.col("window"))
    met = met.where((F.col("prefix") == "") | F.when(fits, same).otherwise(False))
    return met.select("row", "n_words", "begin", "length", "number")


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_list (ids as text, sorted) and spans of every row.

    spans are the found windows as (begin, end) in words, sorted.
    """
    every = stored(item_windows(items, "item_id", text, size), "item-windows")
    made = stored(numbered(every), "windows")
    times = rarity(docs, text, made)
    chosen = stored(prefixes(made, times), "prefixes")
    parts = sliced(chosen, SLICE, "window")
    # a row number of its own keeps rows of the same id apart; it is the same whenever a task is run again
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("n"), F.col(doc_id).alias("id")).alias("row"), text_words(F.col(text)).alias("words"))
    end = docs.sparkSession.range(1).select(
        F.lit(None).cast("long").alias("number"), F.array().cast("array<string>").alias("window"), F.lit("").alias("prefix"), F.lit(0).alias("place")
    )
    met = reduce(DataFrame.unionAll, [found_windows(rows, p.unionAll(end)) for p in parts])
    span = F.when(F.col("length") > 0, F.struct(F.col("begin").cast("int").alias("begin"), (F.col("begin") + F.col("length")).cast("int").alias("end")))
    by = met.groupBy("row").agg(
        F.max("n_words").cast("long").alias("n_words"), F.sort_array(F.collect_set(span)).alias("spans"), F.collect_set("number").alias("numbers")
    )
    by = stored(by, "found")
    named = every.where("item IS NOT NULL").join(made, "window").select("number", "item").distinct()
    listed = by.select("row", F.explode("numbers").alias("number")).join(named, "number").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("item_list"))
    of_row = F.coalesce(F.col("item_list"), F.array().cast("array<string>"))
    by = by.join(listed, "row", "left").withColumn("item_list", of_row)
    return by.select(F.col("row.id").alias(doc_id), "n_words", covered(F.col("spans")).alias("n_hit"), F.size("item_list").cast("long").alias("n_items"), "item_list", "spans")


def covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("reach"))

    def add(state: Column, s: Column) -> Column:
        new = F.greatest(s["end"] - F.greatest(s["begin"], state["reach"]), F.lit(0))
        return F.struct((state["hit"] + new).alias("hit"), F.greatest(state["reach"], s["end"]).alias("reach"))

    return F.aggregate(spans, start, add, lambda s: s["hit"])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(spark, sf_dir, n) for n in ("documents", "benchmark"))
    found = contaminated(docs, items)
    sha = F.sha2(F.array_join("item_list", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def hit_ctes(docs: str = "documents") -> str:
    """DuckDB: judged(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) from ``docs`` and benchmark."""
    words = "regexp_extract_all(translate(coalesce(text, ''), '" + UPPER + "', '" + LOWER + "'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
doc_words AS (SELECT row_number() OVER () AS n, doc_id, {words} AS w FROM {docs}),
item_words AS (SELECT item_id::VARCHAR AS item, {words} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS length,
         unnest(list_transform(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1), lambda i: array_to_string(w[i : i + {WINDOW} - 1], ' '))) AS win
  FROM item_words WHERE len(w) > 0),
lengths AS (SELECT DISTINCT length FROM item_windows),
doc_starts AS (
  SELECT n, length, w, unnest(range(1, len(w) - length + 2)) AS i FROM doc_words, lengths WHERE len(w) >= length),
doc_windows AS (SELECT n, length, i, array_to_string(w[i : i + length - 1], ' ') AS win FROM doc_starts),
met AS (SELECT n, i, length, item FROM doc_windows JOIN item_windows USING (length, win)),
hit AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(i, i + length)) AS p FROM met) GROUP BY n),
listed AS (SELECT n, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY n),
judged AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
         sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM doc_words LEFT JOIN hit USING (n) LEFT JOIN listed USING (n))"""


SQL = f"WITH {hit_ctes()} SELECT * FROM judged"

QUERIES = {"op7_decontamination": (op7_decontamination, SQL)}
