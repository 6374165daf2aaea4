"""Queries over posts: statistics, projections, guards, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import formats, text
from ..operators import features, model, stats
from ..sources import derived, tables
from . import base_sql as B


def _joined(col: str):
    return F.array_join(col, ",")


def author_stats_top5(spark, sf_dir) -> DataFrame:
    top = stats.top_authors(derived.posts(spark, sf_dir))
    return _rates(top)


def author_stats_all(spark, sf_dir) -> DataFrame:
    return _rates(stats.author_stats(derived.posts(spark, sf_dir)))


def _rates(df: DataFrame) -> DataFrame:
    return df.select(
        "author",
        "post_count",
        F.round("labelled_rate", 6).alias("labelled_rate"),
        F.round("notification_rate", 6).alias("notification_rate"),
    )


_AUTHORS_SQL = """
SELECT author, count(*) AS post_count,
       round(avg((notify IS NOT NULL)::INT), 6) AS labelled_rate,
       round(avg(notify::INT), 6) AS notification_rate
FROM posts GROUP BY author"""


def corpus_stats(spark, sf_dir) -> DataFrame:
    return _percents(stats.corpus_stats(derived.posts(spark, sf_dir)))


def site_stats(spark, sf_dir) -> DataFrame:
    return _percents(stats.corpus_stats(derived.posts_by_site(spark, sf_dir), by=["site"]))


def _percents(df: DataFrame) -> DataFrame:
    rounded = {c: F.round(c, 6) for c in ("percent_labelled", "notification_rate")}
    return df.withColumns(rounded)


_CORPUS_COLUMNS = """count(*) AS post_count,
       round(avg((notify IS NOT NULL)::INT) * 100, 6) AS percent_labelled,
       round(avg(notify::INT) * 100, 6) AS notification_rate"""


def stats_report_lines(spark, sf_dir) -> DataFrame:
    return stats.statistics_report(derived.posts(spark, sf_dir))


def site_report_lines(spark, sf_dir) -> DataFrame:
    """The report of every site, as a statistics request for all sites answers."""
    return stats.statistics_report(derived.posts_by_site(spark, sf_dir), by=["site"])


_BY_SITE = """
by_site AS (SELECT * REPLACE (CASE WHEN lang = 'en' THEN 'gallery' ELSE 'microblog' END AS site) FROM posts),
top AS (
  SELECT site, author, count(*) AS n, avg((notify IS NOT NULL)::INT) * 100 AS l, avg(notify::INT) * 100 AS r
  FROM by_site GROUP BY site, author
  QUALIFY row_number() OVER (PARTITION BY site ORDER BY n DESC, author) <= 5),
corpus AS (
  SELECT site, count(*) AS n, avg((notify IS NOT NULL)::INT) * 100 AS l, avg(notify::INT) * 100 AS r FROM by_site GROUP BY site)"""
_SITE_REPORT_SQL = """
SELECT site, 0 AS line_no, 'Number of Posts: ' || n AS line FROM corpus
UNION ALL SELECT site, 1, 'Percent Labelled: ' || coalesce(printf('%.2f', l), 'nan') || '%' FROM corpus
UNION ALL SELECT site, 2, 'Notification Rate: ' || coalesce(printf('%.2f', r), 'nan') || '%' FROM corpus
UNION ALL SELECT site, 3, 'Top-5 Author Statistics:' FROM corpus
UNION ALL SELECT site, 3 + row_number() OVER (PARTITION BY site ORDER BY n DESC, author),
  author || ' ' || n || ' ' || coalesce(printf('%.2f', l), 'nan') || '% '
         || coalesce(printf('%.2f', r), 'nan') || '%' FROM top"""

_REPORT_TABLES = (
    """
top AS (
  SELECT author, count(*) AS n, avg((notify IS NOT NULL)::INT) * 100 AS l, avg(notify::INT) * 100 AS r
  FROM posts GROUP BY author ORDER BY n DESC, author LIMIT 5)""",
    """
corpus AS (
  SELECT count(*) AS n, avg((notify IS NOT NULL)::INT) * 100 AS l, avg(notify::INT) * 100 AS r FROM posts)""",
)
_REPORT_SQL = """
SELECT 0 AS line_no, 'Number of Posts: ' || n AS line FROM corpus
UNION ALL SELECT 1, 'Percent Labelled: ' || coalesce(printf('%.2f', l), 'nan') || '%' FROM corpus
UNION ALL SELECT 2, 'Notification Rate: ' || coalesce(printf('%.2f', r), 'nan') || '%' FROM corpus
UNION ALL SELECT 3, 'Top-5 Author Statistics:'
UNION ALL SELECT 3 + row_number() OVER (ORDER BY n DESC, author),
  author || ' ' || n || ' ' || coalesce(printf('%.2f', l), 'nan') || '% '
         || coalesce(printf('%.2f', r), 'nan') || '%' FROM top"""


def flatten_posts(spark, sf_dir) -> DataFrame:
    flat = tables.select_posts(derived.posts(spark, sf_dir))
    return flat.withColumn("tag_names", _joined("tag_names")).drop("site")


def unlabelled_posts(spark, sf_dir) -> DataFrame:
    flat = tables.select_posts(derived.posts(spark, sf_dir), labelled=False)
    return flat.select("post_id", "title", "author")


def lookup_post(spark, sf_dir) -> DataFrame:
    """The post with the greatest id, found by id."""
    last = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.max("doc_id")).first()[0]
    found = tables.find_post(derived.posts(spark, sf_dir), "gallery", str(last))
    return found.select("post_id", "url", "title", "description")


def training_guard(spark, sf_dir) -> DataFrame:
    posts = derived.posts_by_site(spark, sf_dir)
    return model.training_guard(posts, by=("site",)).drop("positive")


def class_weights(spark, sf_dir) -> DataFrame:
    weights = model.class_weights(derived.posts(spark, sf_dir))
    return weights.withColumn("weight", F.round("weight", 6))


def fallback_scores(spark, sf_dir) -> DataFrame:
    """Every author as a site of its own: most have too few labels for a model."""
    posts = derived.posts(spark, sf_dir).withColumn("site", F.col("author.username"))
    return model.fallback_scores(posts).select("site", "post_id", "reason", "score")


_REASON = """CASE WHEN labelled < 20 THEN 'not_enough_labelled'
            WHEN with_description < 10 THEN 'not_enough_descriptions'
            WHEN positive = 0 OR positive = labelled THEN 'single_class' END"""
_GUARD = """count(notify) AS labelled,
         count(*) FILTER (notify IS NOT NULL AND length(description) > 0) AS with_description,
         count(*) FILTER (notify) AS positive"""


def post_text(spark, sf_dir) -> DataFrame:
    pages = derived.page_posts(spark, sf_dir)
    body = text.display_text(F.col("description"))
    return pages.select("post_id", formats.full_text(F.col("title"), body).alias("text"))


def html_text(spark, sf_dir) -> DataFrame:
    pages = derived.page_posts(spark, sf_dir)
    return pages.select("post_id", text.strip_html(F.col("description")).alias("text"))


def page_tokens(spark, sf_dir) -> DataFrame:
    pages = features.spread(derived.page_posts(spark, sf_dir))
    tokens = text.description_tokens(F.col("description"))
    return pages.select("post_id", F.array_join(tokens, " ").alias("tokens"))


def tokens(spark, sf_dir) -> DataFrame:
    posts = features.spread(derived.posts(spark, sf_dir))
    return posts.select(
        "post_id",
        F.array_join(text.title_tokens(F.col("title")), " ").alias("title_tokens"),
        F.array_join(text.description_tokens(F.col("description")), " ").alias("description_tokens"),
    )


def _term_arrays(spark, sf_dir) -> DataFrame:
    return features.with_terms(tables.select_posts(derived.posts(spark, sf_dir)))


def _counts(spark, sf_dir) -> DataFrame:
    return features.term_counts(_term_arrays(spark, sf_dir))


def _n_posts(spark, sf_dir) -> int:
    return derived.table(spark, sf_dir, "documents").count()


def ngram_counts(spark, sf_dir) -> DataFrame:
    return features.term_counts(_term_arrays(spark, sf_dir), blocks=features.PRUNED_BLOCKS).drop("site")


def pruned_vocab(spark, sf_dir) -> DataFrame:
    vocab = features.vocabulary(_counts(spark, sf_dir), _n_posts(spark, sf_dir))
    return vocab.where(F.col("block").isin(*features.PRUNED_BLOCKS))


def tag_vocab(spark, sf_dir) -> DataFrame:
    counts = features.term_counts(
        tables.select_posts(derived.posts(spark, sf_dir)).withColumnRenamed("tag_names", "tags_terms"),
        blocks=("tags",),
    )
    return features.vocabulary(counts, _n_posts(spark, sf_dir))


def tfidf_weights(spark, sf_dir) -> DataFrame:
    weights = features.written_tfidf(tables.select_posts(derived.posts(spark, sf_dir)), _n_posts(spark, sf_dir))
    return weights.withColumn("weight", F.round("weight", 6)).drop("site")


_DISPLAY_SQL = (
    "regexp_replace(regexp_replace("
    + B.decode_entities_sql(B.strip_html_sql("html", "chr(10)"))
    + r", '[ \t\r\f]*\n[ \t\r\f\n]*', chr(10), 'g'), '^\n+|\n+$', '', 'g')"
)
_PAGE_TEXT = B.decode_entities_sql(B.strip_html_sql("lower(html)"))

QUERIES = {
    "author_stats_top5": (
        author_stats_top5,
        B.with_tables(_AUTHORS_SQL + " ORDER BY post_count DESC, author LIMIT 5", B.POSTS),
    ),
    "author_stats_all": (author_stats_all, B.with_tables(_AUTHORS_SQL, B.POSTS)),
    "corpus_stats": (corpus_stats, B.with_tables(f"SELECT {_CORPUS_COLUMNS} FROM posts", B.POSTS)),
    "site_stats": (
        site_stats,
        B.with_tables(
            "SELECT CASE WHEN lang = 'en' THEN 'gallery' ELSE 'microblog' END AS site, "
            f"{_CORPUS_COLUMNS} FROM posts GROUP BY 1",
            B.POSTS,
        ),
    ),
    "stats_report_lines": (
        stats_report_lines,
        B.with_tables(_REPORT_SQL, B.POSTS, *_REPORT_TABLES),
    ),
    "site_report_lines": (site_report_lines, B.with_tables(_SITE_REPORT_SQL, B.POSTS, _BY_SITE)),
    "flatten_posts": (
        flatten_posts,
        B.with_tables(
            "SELECT post_id, url, title, description, notify, "
            "array_to_string(tag_names, ',') AS tag_names, author FROM posts",
            B.POSTS,
        ),
    ),
    "unlabelled_posts": (
        unlabelled_posts,
        B.with_tables("SELECT post_id, title, author FROM posts WHERE notify IS NULL", B.POSTS),
    ),
    "lookup_post": (
        lookup_post,
        B.with_tables(
            "SELECT post_id, url, title, description FROM posts "
            "WHERE post_id = (SELECT max(doc_id)::VARCHAR FROM documents)",
            B.POSTS,
        ),
    ),
    "training_guard": (
        training_guard,
        B.with_tables(
            f"""SELECT site, labelled, with_description, {_REASON} AS reason, ({_REASON}) IS NULL AS ok
            FROM (SELECT CASE WHEN lang = 'en' THEN 'gallery' ELSE 'microblog' END AS site, {_GUARD}
                  FROM posts GROUP BY 1)""",
            B.POSTS,
        ),
    ),
    "class_weights": (
        class_weights,
        B.with_tables(
            """SELECT notify, count(*) AS n_class, round((SELECT count(notify) FROM posts)
                 / ((SELECT count(DISTINCT notify) FROM posts)::DOUBLE * count(*)), 6) AS weight
            FROM posts WHERE notify IS NOT NULL GROUP BY notify""",
            B.POSTS,
        ),
    ),
    "fallback_scores": (
        fallback_scores,
        B.with_tables(
            f"""SELECT author AS site, post_id, reason,
                 CASE WHEN reason IS NOT NULL THEN 1.0::DOUBLE END AS score
            FROM posts JOIN (SELECT author, {_REASON} AS reason
                             FROM (SELECT author, {_GUARD} FROM posts GROUP BY author)) USING (author)""",
            B.POSTS,
        ),
    ),
    "post_text": (
        post_text,
        f"SELECT page_id::VARCHAR AS post_id, url || chr(10) || repeat('-', 86) || chr(10) || {_DISPLAY_SQL} AS text FROM pages",
    ),
    "html_text": (
        html_text,
        "SELECT page_id::VARCHAR AS post_id, "
        + B.decode_entities_sql(B.strip_html_sql("html"))
        + " AS text FROM pages",
    ),
    "page_tokens": (
        page_tokens,
        B.with_tables(
            "SELECT page_id::VARCHAR AS post_id, array_to_string(tokens, ' ') AS tokens FROM tokens",
            B.tokens_ctes("pages", "page_id", {"description": _PAGE_TEXT}),
        ),
    ),
    "tokens": (
        tokens,
        B.with_tables(
            """SELECT post_id, array_to_string(max(tokens) FILTER (block = 'title'), ' ') AS title_tokens,
                 array_to_string(max(tokens) FILTER (block = 'description'), ' ') AS description_tokens
            FROM tokens GROUP BY post_id""",
            B.POSTS,
            B.post_tokens_ctes(),
        ),
    ),
    "ngram_counts": (
        ngram_counts,
        B.with_tables(
            "SELECT post_id, block, term, tf FROM counts WHERE block <> 'tags'",
            B.POSTS,
            B.post_tokens_ctes(),
            B.grams_ctes(),
        ),
    ),
    "pruned_vocab": (
        pruned_vocab,
        B.with_tables(
            "SELECT block, term, df FROM vocab WHERE block <> 'tags'",
            B.POSTS,
            B.post_tokens_ctes(),
            B.grams_ctes(),
            B.VOCAB,
        ),
    ),
    "tag_vocab": (
        tag_vocab,
        B.with_tables(
            "SELECT 'tags' AS block, term, count(*) AS df FROM "
            "(SELECT post_id, unnest(tag_names) AS term FROM posts) GROUP BY term",
            B.POSTS,
        ),
    ),
    "tfidf_weights": (
        tfidf_weights,
        B.with_tables(
            """SELECT post_id, block, term,
                 round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY post_id, block)), 6) AS weight
            FROM (SELECT post_id, block, term,
                         tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1) AS raw
                  FROM counts JOIN vocab USING (block, term))""",
            B.POSTS,
            B.post_tokens_ctes(),
            B.grams_ctes(),
            B.VOCAB,
        ),
    ),
}
