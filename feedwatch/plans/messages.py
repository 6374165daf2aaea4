"""Queries over messages, feedback, requests, label selection and the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..conf import shared_dir
from ..functions import formats
from ..operators import commands, feedback, labelling, linear, model, routing
from ..operators.ingest import download_posts
from ..sources import derived
from ..sources import schemas as S
from ..sources.tables import decode_classification
from ..streaming.feedback import current_labels, start_feedback
from ..streaming.route import merged_stream, start_notifier, start_router, stream_messages
from . import base_sql as B

LABEL_COUNT = 50


def _message_sources(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored messages: ingested ones, label requests and posts added by hand."""
    scored = derived.scored_posts(spark, sf_dir)
    selected = labelling.select_to_label(scored.where(F.col("notify").isNull()), LABEL_COUNT)
    found, _ = labelling.find_selected(selected, scored)
    scores = scored.select("site", "post_id", "score")
    label_requests = labelling.label_messages(found).join(scores, ["site", "post_id"], "left")
    added = labelling.add_messages(_downloads(spark, sf_dir)).join(scores, ["site", "post_id"], "left")
    return derived.messages(spark, sf_dir), label_requests, added


def _all_messages(spark, sf_dir) -> DataFrame:
    """The messages of all sources in one set."""
    return routing.merge_messages(*_message_sources(spark, sf_dir))


def _downloads(spark, sf_dir) -> DataFrame:
    """Web pages' ids as posts to add by hand, and as many ids that do not exist."""
    pages = derived.table(spark, sf_dir, "pages").select("page_id")
    ids = pages.select(
        F.lit("gallery").alias("site"),
        F.explode(
            F.array(F.col("page_id").cast("string"), F.concat(F.lit("x"), "page_id"))
        ).alias("post_id"),
    )
    return download_posts(ids, derived.posts(spark, sf_dir))


def download_requests(spark, sf_dir) -> DataFrame:
    return _downloads(spark, sf_dir).select("post_id", "url", "title", "error")


def route_notifications(spark, sf_dir) -> DataFrame:
    return _routed(_all_messages(spark, sf_dir), routing.NOTIFICATION_THRESHOLD)


def route_threshold(spark, sf_dir) -> DataFrame:
    return _routed(_all_messages(spark, sf_dir), 0.5)


def _routed(messages: DataFrame, threshold: float) -> DataFrame:
    routed = routing.route(messages, threshold)
    return routed.select("post_id", "set_notify", "skip_write", "score", "classify_error")


def messages_to_write(spark, sf_dir) -> DataFrame:
    return routing.to_write(_all_messages(spark, sf_dir)).select("post_id", "set_notify", "url")


def notification_text(spark, sf_dir) -> DataFrame:
    """Notifications of all posts, the non-English ones as microblog posts."""
    by_site = derived.posts_by_site(spark, sf_dir).select("post_id", "site")
    routed = routing.route(derived.messages(spark, sf_dir)).drop("site").join(by_site, "post_id")
    sent = routing.notifications(routed)
    return sent.withColumn("callbacks", F.array_join("callbacks", "|")).withColumn(
        "score", F.round("score", 6)
    )


def stream_route(spark, sf_dir) -> DataFrame:
    """The same routing as a stream over landed messages with a static score table."""
    base = shared_dir(spark, "route")
    all_messages = derived.messages(spark, sf_dir)
    all_messages.drop("score").write.parquet(f"{base}/messages")
    stream = stream_messages(spark, f"{base}/messages", all_messages.drop("score").schema)
    scores = all_messages.select("site", "post_id", "score")
    out = f"{base}/notifications"
    start_router(stream, scores, out, f"{base}/checkpoint").awaitTermination()
    sent = spark.read.parquet(out)
    return sent.select("post_id", "set_notify", "skip_write", "score", "classify_error")


def stream_notifications(spark, sf_dir) -> DataFrame:
    """Ingested messages, label requests and posts added by hand as one stream, started again after it ended."""
    base = shared_dir(spark, "notify")
    ingested, label_requests, added = _message_sources(spark, sf_dir)
    streams = []
    for name, rows in (("ingested", ingested), ("label", label_requests), ("added", added)):
        rows.write.parquet(f"{base}/{name}")
        streams.append(stream_messages(spark, f"{base}/{name}", rows.schema))
    out = f"{base}/notifications"
    for _ in range(2):
        start_notifier(merged_stream(*streams), out, f"{base}/checkpoint").awaitTermination()
    sent = spark.read.parquet(out)
    return sent.select("post_id", "set_notify", "skip_write", "score", "classify_error")


def route_replies(spark, sf_dir) -> DataFrame:
    """Messages routed by the classifier's JSON answers, some of which are refusals and some cut short."""
    answered = F.struct(
        F.lit(True).alias("success"), F.col("post_id").alias("id"), "site", (F.col("score") >= 0.5).alias("notify"), "score"
    )
    refused = F.struct(F.lit(False).alias("success"), F.lit("invalid_request").alias("error"), F.lit("no description").alias("error_description"))
    body = F.when(F.col("description") == "", F.to_json(refused)).otherwise(F.to_json(answered))
    cut = F.when(F.col("score") > 0.95, F.substring(body, 1, 20)).otherwise(body)
    replies = derived.scored_posts(spark, sf_dir).select("site", "post_id", cut.alias("body"))
    answers = decode_classification(replies).select("site", "post_id", "score", "classify_failure")
    messages = derived.messages(spark, sf_dir).drop("score").join(answers, ["site", "post_id"])
    routed = routing.route(messages)
    return routed.select("post_id", "set_notify", "skip_write", "score", "classify_error", "classify_failure")


def parse_callbacks(spark, sf_dir) -> DataFrame:
    log = derived.feedback(spark, sf_dir)
    data = F.concat(F.lit(" "), "op", F.lit("  "), "site", F.lit(" "), "post_id", F.lit("\n"))
    return log.select("seq", formats.parse_callback(data).alias("c")).select("seq", "c.*")


def feedback_state(spark, sf_dir) -> DataFrame:
    return feedback.fold_feedback(derived.feedback(spark, sf_dir)).select("post_id", "notify")


def apply_feedback(spark, sf_dir) -> DataFrame:
    """Button presses applied to the stored posts (labels and deletes)."""
    log = feedback.feedback_log(derived.feedback(spark, sf_dir).withColumnRenamed("op", "button"))
    after = feedback.apply_feedback(derived.posts(spark, sf_dir), log)
    return after.select("post_id", "title", "notify")


def stream_feedback(spark, sf_dir) -> DataFrame:
    base = shared_dir(spark, "feedback")
    log = derived.feedback(spark, sf_dir)
    log.repartition(4, "post_id").write.parquet(f"{base}/landing")
    stream = (
        spark.readStream.schema(S.FEEDBACK).option("maxFilesPerTrigger", 2).parquet(f"{base}/landing")
    )
    start_feedback(stream, base).awaitTermination()
    return current_labels(spark, base).select("post_id", "notify")


def _by_type(values: dict[str, Column]) -> Column:
    chosen = F.lit(None).cast("string")
    for kind, value in values.items():
        chosen = F.when(F.col("event_type") == kind, value).otherwise(chosen)
    return chosen


def command_args(spark, sf_dir) -> DataFrame:
    """One command per event; what it is depends on the event type."""
    events = derived.table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    text = _by_type(
        {
            "signup": F.concat(F.lit("/add gallery "), user),
            "click": F.concat(F.lit("/label Microblog  "), user, F.lit(" ")),
            "error": F.lit("/retrain"),
            "view": F.concat(F.lit("/stats q"), user),
            "purchase": F.concat(F.lit("/stats gallery "), user),
        }
    )
    parsed = commands.parse_commands(events.select("event_id", text.alias("text")))
    return parsed.select(
        "event_id", "command", F.array_join("args", "|").alias("args"), "arity_ok", "site"
    )


def _request_columns(events: DataFrame) -> DataFrame:
    site = _by_type(
        {
            "signup": F.lit("gallery"),
            "click": F.lit("all"),
            "error": F.lit(None).cast("string"),
            "view": F.concat(F.lit("site"), F.col("user_id") % 3),
            "purchase": F.lit("microblog"),
        }
    )
    return events.select(F.col("event_id").alias("request_id"), site.alias("site"), "value", "props", "user_id")


def service_requests(spark, sf_dir) -> DataFrame:
    """The request of every event checked as retrain, statistics and label request."""
    requests = _request_columns(derived.table(spark, sf_dir, "events"))
    count = F.when(F.col("value") < 5, F.lit(None)).when(F.col("value") < 10, F.lit("many"))
    requests = requests.withColumn(
        "count_arg", count.otherwise(F.get_json_object("props", "$.k"))
    )
    retrain = commands.check_site_requests(requests, "retrain").withColumn("kind", F.lit("retrain"))
    stats = commands.check_site_requests(requests, "stats").withColumn("kind", F.lit("stats"))
    label = commands.check_label_requests(requests).withColumn("kind", F.lit("label"))
    checked = routing.merge_messages(retrain, stats, label)
    return checked.select(
        "request_id", "kind", "site", "count", "success", "error", "error_description"
    )


def _matched_requests(spark, sf_dir) -> DataFrame:
    """A classify request per event against a store that holds the labelled posts twice."""
    events = derived.table(spark, sf_dir, "events")
    n_posts = derived.table(spark, sf_dir, "documents").count()
    post_id = F.when(F.col("value") >= 1, F.pmod("request_id", F.lit(n_posts * 6 // 5)).cast("string"))
    requests = _request_columns(events).select("request_id", "site", post_id.alias("post_id"))
    posts = derived.posts(spark, sf_dir).select("site", "post_id", "notify")
    store = posts.unionByName(posts.where(F.col("notify").isNotNull()))
    return commands.match_classify_requests(commands.check_classify_requests(requests), store)


def classify_answers(spark, sf_dir) -> DataFrame:
    """What each classify request is answered, with the stand-in model's score."""
    scored = derived.scored_posts(spark, sf_dir)
    answered = commands.answer_classify_requests(_matched_requests(spark, sf_dir), scored)
    return answered.select(
        "request_id", "site", "post_id", "success", F.round("score", 6).alias("score"), "notify", "error"
    )


def classify_requests(spark, sf_dir) -> DataFrame:
    return _matched_requests(spark, sf_dir).select(
        "request_id", "site", "post_id", "n_matches", "success", "error", "error_description"
    )


def _unlabelled(spark, sf_dir) -> DataFrame:
    return derived.scored_posts(spark, sf_dir).where(F.col("notify").isNull())


def label_topk(spark, sf_dir) -> DataFrame:
    picked = labelling.nearest_to_decision(_unlabelled(spark, sf_dir), LABEL_COUNT)
    return picked.select("post_id", F.round("distance", 6).alias("distance"))


def label_with_random(spark, sf_dir) -> DataFrame:
    return labelling.select_to_label(_unlabelled(spark, sf_dir), LABEL_COUNT).drop("site")


def label_distinct(spark, sf_dir) -> DataFrame:
    return labelling.select_to_label(_unlabelled(spark, sf_dir), LABEL_COUNT, distinct=True).drop("site")


def label_messages(spark, sf_dir) -> DataFrame:
    selected = labelling.select_to_label(_unlabelled(spark, sf_dir), LABEL_COUNT)
    found, _ = labelling.find_selected(selected, derived.posts(spark, sf_dir))
    added = labelling.add_messages(_downloads(spark, sf_dir))
    merged = routing.merge_messages(labelling.label_messages(found), added)
    return merged.select("post_id", "set_notify", "skip_write")


_MODELS: dict[tuple[str, str], model.NotificationModel] = {}


def trained_model(spark, sf_dir) -> model.NotificationModel:
    """The model of this session and data, trained once and kept by version on disk."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        fitted = model.train(derived.posts(spark, sf_dir))
        path = shared_dir(spark, "model")
        fitted.save(path, 1)
        _MODELS[key] = model.NotificationModel.load(path, 1)
    return _MODELS[key]


def model_scores(spark, sf_dir) -> DataFrame:
    scored = trained_model(spark, sf_dir).score(derived.posts(spark, sf_dir))
    return scored.select("post_id", "notify", "score", "would_notify")


def label_from_model(spark, sf_dir) -> DataFrame:
    posts = derived.posts(spark, sf_dir)
    return trained_model(spark, sf_dir).select_to_label(posts, LABEL_COUNT).drop("site")


def rescored_text(spark, sf_dir) -> DataFrame:
    """Full text and fresh score of every post the feedback log asks to print."""
    log = derived.feedback(spark, sf_dir).where(F.col("op") == "cb_print")
    asked = log.select("site", "post_id").distinct()
    posts = derived.posts(spark, sf_dir).join(asked, ["site", "post_id"], "left_semi")
    return routing.printed_posts(trained_model(spark, sf_dir).score(posts))


_TABLES: dict[tuple[str, str], linear.TableModel] = {}


def table_model(spark, sf_dir) -> linear.TableModel:
    """The counted model of this session and data, kept by version on disk."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        path = shared_dir(spark, "counted")
        linear.log_ratio_model(derived.posts(spark, sf_dir)).save(path, 1)
        _TABLES[key] = linear.TableModel.load(spark, path, 1)
    return _TABLES[key]


def table_scores(spark, sf_dir) -> DataFrame:
    """Every post scored by joining its terms with a model table."""
    scored = table_model(spark, sf_dir).score(derived.posts(spark, sf_dir))
    return scored.select("post_id", "notify", F.round("score", 6).alias("score"), "would_notify")


def table_terms(spark, sf_dir) -> DataFrame:
    terms = table_model(spark, sf_dir).terms
    return terms.select("block", "term", "df", F.round("idf", 6).alias("idf"), F.round("weight", 6).alias("weight"))


def label_from_table(spark, sf_dir) -> DataFrame:
    return table_model(spark, sf_dir).select_to_label(derived.posts(spark, sf_dir), LABEL_COUNT).drop("site")


def rescored_table_text(spark, sf_dir) -> DataFrame:
    """Full text and score from the model table of every post the feedback log asks to print."""
    log = derived.feedback(spark, sf_dir).where(F.col("op") == "cb_print")
    posts = derived.posts(spark, sf_dir).join(log.select("site", "post_id").distinct(), ["site", "post_id"], "left_semi")
    printed = routing.printed_posts(table_model(spark, sf_dir).score(posts))
    return printed.select("post_id", F.round("score", 6).alias("score"), "text")


def _selected_sql(scored: str) -> str:
    return f"""
unlabelled AS (SELECT *, abs(score - 0.5::DOUBLE) AS distance FROM {scored} WHERE notify IS NULL),
picked AS (
  SELECT *, row_number() OVER (ORDER BY distance, {B.rank_sql('post_id', '42:shuffle')}, post_id) AS slot
  FROM unlabelled QUALIFY slot <= {LABEL_COUNT}),
drawn AS (
  SELECT post_id AS random_id, row_number() OVER (ORDER BY {B.rank_sql('post_id', '42:sample')}, post_id) AS slot
  FROM unlabelled QUALIFY slot <= {LABEL_COUNT}),
selected AS (
  SELECT slot, CASE WHEN coin THEN random_id ELSE post_id END AS post_id, coin AS randomised
  FROM (SELECT *, {B.rank_sql('slot', '42:slot')} % 1000 < 200 AS coin FROM picked JOIN drawn USING (slot)))"""


_SELECTED = _selected_sql("scored")
_COUNTED = f"""
{B.post_tokens_ctes().strip()},
{B.grams_ctes().strip()},
label_counts AS (
  SELECT count(*) FILTER (notify) AS np, count(*) FILTER (NOT notify) AS nn FROM posts),
counted AS (
  SELECT block, term, count(*) AS df, count(*) FILTER (p.notify) AS pos
  FROM counts JOIN posts p USING (post_id) WHERE p.notify IS NOT NULL GROUP BY block, term),
model AS (
  SELECT block, term, df, ln((1.0::DOUBLE + np + nn) / (1.0::DOUBLE + df)) + 1 AS idf,
         ln((pos + 1.0::DOUBLE) / (np + 2.0::DOUBLE)) - ln((df - pos + 1.0::DOUBLE) / (nn + 2.0::DOUBLE)) AS weight
  FROM counted, label_counts WHERE block = 'tags' OR (df >= 2 AND df <= 0.8::DOUBLE * (np + nn))),
block_sums AS (
  SELECT post_id, block, sum(tf * idf * weight) AS dot, sum(tf * idf * tf * idf) AS square
  FROM counts JOIN model USING (block, term) GROUP BY post_id, block),
table_scored AS (
  SELECT p.*, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-coalesce(m.margin, 0))), 9) AS score
  FROM posts p LEFT JOIN (SELECT post_id, sum(dot / sqrt(square)) AS margin FROM block_sums GROUP BY post_id) m USING (post_id))"""
_DOWNLOADS = """
downloads AS (
  SELECT r.post_id, p.url, p.title, CASE WHEN p.post_id IS NULL THEN 'post not found' END AS error
  FROM (SELECT page_id::VARCHAR AS post_id FROM pages UNION ALL SELECT 'x' || page_id FROM pages) r
       LEFT JOIN posts p ON r.post_id = p.post_id)"""
_ALL_MESSAGES = """
all_messages AS (
  SELECT post_id, url, set_notify, skip_write, score FROM messages
  UNION ALL SELECT post_id, url, true, true, score FROM selected JOIN scored USING (post_id)
  UNION ALL SELECT d.post_id, d.url, true, false, s.score
            FROM downloads d JOIN scored s ON d.post_id = s.post_id)"""
_MSG = (B.POSTS, B.SCORED, B.MESSAGES, _SELECTED, _DOWNLOADS, _ALL_MESSAGES)


def _route_sql(source: str, threshold: str) -> str:
    return f"""SELECT post_id, set_notify, skip_write, coalesce(score, 0.0::DOUBLE) AS score,
                 score IS NULL AS classify_error
            FROM {source} WHERE coalesce(set_notify, true)
              AND (coalesce(score, 0) > {threshold} OR coalesce(set_notify, false))"""


_NOTIFICATION_SQL = """
SELECT site, post_id, round(score, 6) AS score, link,
       'Score: ' || printf('%.2f', score) || chr(10) || link AS text,
       array_to_string(list_transform(['cb_print', 'cb_true', 'cb_false', 'cb_hide', 'cb_delete'],
         lambda b: b || ' ' || site || ' ' || post_id), '|') AS callbacks,
       'id=' || post_id || '&site=' || site AS request
FROM (SELECT post_id, coalesce(score, 0)::DOUBLE AS score, site,
             CASE WHEN site = 'microblog' THEN 'http://twitter.com/statuses/' || post_id ELSE url END AS link
      FROM (SELECT m.* EXCLUDE (site), CASE WHEN p.lang = 'en' THEN 'gallery' ELSE 'microblog' END AS site
            FROM messages m JOIN posts p USING (post_id))
      WHERE coalesce(set_notify, true))"""

_FOLD = """
deletes AS (SELECT post_id, max(seq) AS ld FROM feedback WHERE op = 'cb_delete' GROUP BY post_id),
after_delete AS (
  SELECT f.* FROM feedback f LEFT JOIN deletes d USING (post_id) WHERE f.seq > coalesce(d.ld, -1)),
bases AS (SELECT post_id, min(seq) AS base FROM after_delete WHERE op = 'insert' GROUP BY post_id),
folded AS (
  SELECT b.post_id, arg_max(a.op = 'cb_true', a.seq) FILTER (a.op IN ('cb_true', 'cb_false') AND a.seq > b.base) AS notify
  FROM bases b JOIN after_delete a USING (post_id) GROUP BY b.post_id)"""

_SITE_OF_EVENT = """CASE event_type WHEN 'signup' THEN 'gallery' WHEN 'click' THEN 'all'
     WHEN 'view' THEN 'site' || (user_id % 3) WHEN 'purchase' THEN 'microblog' END"""

_SERVICE_SQL = f"""
WITH r AS (
  SELECT event_id AS request_id, {_SITE_OF_EVENT} AS site,
         CASE WHEN value < 5 THEN NULL WHEN value < 10 THEN 'many' ELSE json_extract_string(props, '$.k') END AS c
  FROM events),
checked AS (
  SELECT request_id, 'retrain' AS kind, site, NULL::INT AS count,
         CASE WHEN site IS NULL THEN 'Must provide the site to rebuild model for'
              WHEN site NOT IN ('all', 'gallery', 'microblog') THEN 'Cannot find site ' || site END AS error,
         NULL AS error_description FROM r
  UNION ALL
  SELECT request_id, 'stats', site, NULL,
         CASE WHEN site IS NULL THEN 'Must provide the site to get statistics for'
              WHEN site NOT IN ('all', 'gallery', 'microblog') THEN 'Cannot find site ' || site END, NULL FROM r
  UNION ALL
  SELECT request_id, 'label', site, TRY_CAST(c AS INT),
         CASE WHEN c IS NULL THEN 'invalid_request' WHEN TRY_CAST(c AS INT) IS NULL THEN 'not a number: ' || c
              WHEN site IS NULL THEN 'invalid_request'
              WHEN site NOT IN ('gallery', 'microblog') THEN 'Cannot find site ' || site END,
         CASE WHEN c IS NULL THEN 'Must number of posts to label.'
              WHEN TRY_CAST(c AS INT) IS NOT NULL AND site IS NULL
              THEN 'Must provide the site to get posts for.' END FROM r)
SELECT request_id, kind, site, count, error IS NULL AS success, error, error_description FROM checked"""

_CLASSIFY_SQL = f"""
WITH r AS (
  SELECT event_id AS request_id, {_SITE_OF_EVENT} AS site,
         CASE WHEN value >= 1 THEN (event_id % ((SELECT count(*) FROM documents) * 6 // 5))::VARCHAR END AS post_id
  FROM events),
stored AS (
  SELECT doc_id::VARCHAR AS post_id, 1 + (l.doc_id IS NOT NULL)::INT AS n
  FROM documents d LEFT JOIN labels l USING (doc_id)),
v AS (
  SELECT r.*, coalesce(s.n, 0) AS n,
         CASE WHEN r.post_id IS NULL OR site IS NULL THEN 'invalid_request'
              WHEN site NOT IN ('gallery', 'microblog') THEN 'Cannot find site ' || site END AS invalid
  FROM r LEFT JOIN stored s ON r.post_id = s.post_id AND r.site = 'gallery')
SELECT request_id, site, post_id, CASE WHEN invalid IS NULL THEN n END::BIGINT AS n_matches,
       invalid IS NULL AND n = 1 AS success,
       coalesce(invalid, CASE WHEN n = 0 THEN 'id not found in database.'
                              WHEN n > 1 THEN 'id is not unique in database' END) AS error,
       CASE WHEN post_id IS NULL THEN 'Must provide an id to be classified.'
            WHEN site IS NULL THEN 'Must provide the site associated with the id.' END AS error_description
FROM v"""

_ANSWER_SQL = """
SELECT m.request_id, m.site, m.post_id, m.success, round(s.score, 6) AS score, s.score >= 0.5 AS notify, m.error
FROM m LEFT JOIN scored s ON m.success AND m.site = s.site AND m.post_id = s.post_id"""

_COMMAND_SQL = """
WITH c AS (
  SELECT event_id, user_id::VARCHAR AS u, CASE event_type WHEN 'signup' THEN 'add' WHEN 'click' THEN 'label'
         WHEN 'error' THEN 'retrain' ELSE 'stats' END AS command,
         CASE event_type WHEN 'signup' THEN ['gallery', user_id::VARCHAR]
              WHEN 'click' THEN ['Microblog', user_id::VARCHAR] WHEN 'error' THEN []
              WHEN 'view' THEN ['q' || user_id] ELSE ['gallery', user_id::VARCHAR] END AS a
  FROM events),
o AS (SELECT *, CASE WHEN command IN ('retrain', 'stats') THEN len(a) <= 1 ELSE len(a) = 2 END AS arity_ok FROM c)
SELECT event_id, command, array_to_string(a, '|') AS args, arity_ok,
       CASE WHEN arity_ok THEN CASE WHEN len(a) = 0 THEN 'all' WHEN a[1] IN ('gallery', 'Gallery') THEN 'gallery'
            WHEN a[1] IN ('microblog', 'Microblog') THEN 'microblog' END END AS site
FROM o"""

_DISPLAYED = B.strip_html_sql("description", "chr(10)")
_PRINTED_SQL = f"""
SELECT post_id, round(score, 6) AS score,
       'Score: ' || printf('%.2f', score) || chr(10) || title || chr(10) || repeat('-', 86) || chr(10)
       || regexp_replace(regexp_replace({B.decode_entities_sql(_DISPLAYED)},
            '[ \\t\\r\\f]*\\n[ \\t\\r\\f\\n]*', chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS text
FROM table_scored WHERE post_id IN (SELECT post_id FROM feedback WHERE op = 'cb_print')"""

QUERIES = {
    "download_requests": (
        download_requests,
        B.with_tables("SELECT post_id, url, title, error FROM downloads", B.POSTS, _DOWNLOADS),
    ),
    "route_notifications": (
        route_notifications,
        B.with_tables(_route_sql("all_messages", "-0.1"), *_MSG),
    ),
    "route_threshold": (route_threshold, B.with_tables(_route_sql("all_messages", "0.5"), *_MSG)),
    "messages_to_write": (
        messages_to_write,
        B.with_tables("SELECT post_id, set_notify, url FROM all_messages WHERE NOT skip_write", *_MSG),
    ),
    "notification_text": (
        notification_text,
        B.with_tables(_NOTIFICATION_SQL, B.POSTS, B.SCORED, B.MESSAGES),
    ),
    "stream_route": (
        stream_route,
        B.with_tables(_route_sql("messages", "-0.1"), B.POSTS, B.SCORED, B.MESSAGES),
    ),
    "parse_callbacks": (
        parse_callbacks,
        B.with_tables("SELECT seq, op AS button, site, post_id FROM feedback", B.FEEDBACK),
    ),
    "feedback_state": (
        feedback_state,
        B.with_tables("SELECT post_id, notify FROM folded", B.FEEDBACK, _FOLD),
    ),
    "apply_feedback": (
        apply_feedback,
        B.with_tables(
            """SELECT p.post_id, p.title, coalesce(l.label, p.notify) AS notify
            FROM posts p LEFT JOIN (
              SELECT post_id, arg_max(op = 'cb_true', seq) FILTER (op IN ('cb_true', 'cb_false')) AS label,
                     bool_or(op = 'cb_delete') AS gone
              FROM feedback WHERE op IN ('cb_true', 'cb_false', 'cb_delete') GROUP BY post_id) l
              ON p.post_id = l.post_id
            WHERE NOT coalesce(l.gone, false)""",
            B.POSTS,
            B.FEEDBACK,
        ),
    ),
    "stream_feedback": (
        stream_feedback,
        B.with_tables("SELECT post_id, notify FROM folded", B.FEEDBACK, _FOLD),
    ),
    "command_args": (command_args, _COMMAND_SQL),
    "service_requests": (service_requests, _SERVICE_SQL),
    "classify_answers": (
        classify_answers,
        B.with_tables(_ANSWER_SQL, f"m AS ({_CLASSIFY_SQL})", B.POSTS, B.SCORED),
    ),
    "classify_requests": (classify_requests, _CLASSIFY_SQL),
    "label_topk": (
        label_topk,
        B.with_tables(
            "SELECT post_id, round(distance, 6) AS distance FROM picked", B.POSTS, B.SCORED, _SELECTED
        ),
    ),
    "stream_notifications": (
        stream_notifications,
        B.with_tables(_route_sql("all_messages", "-0.1::DOUBLE"), *_MSG),
    ),
    "route_replies": (
        route_replies,
        B.with_tables(
            f"""SELECT r.*, CASE WHEN classify_error THEN CASE WHEN p.description = '' AND NOT p.score > 0.95 THEN 'no description'
                                 ELSE 'answer not understood' END END AS classify_failure
            FROM ({_route_sql("(SELECT post_id, set_notify, skip_write, CASE WHEN score <= 0.95 THEN score END AS score FROM messages)", "-0.1::DOUBLE")}) r
                 JOIN scored p USING (post_id)""",
            B.POSTS,
            B.SCORED,
            B.MESSAGES,
        ),
    ),
    "table_terms": (
        table_terms,
        B.with_tables("SELECT block, term, df, round(idf, 6) AS idf, round(weight, 6) AS weight FROM model", B.POSTS, _COUNTED),
    ),
    "table_scores": (
        table_scores,
        B.with_tables(
            "SELECT post_id, notify, round(score, 6) AS score, score >= 0.5 AS would_notify FROM table_scored", B.POSTS, _COUNTED
        ),
    ),
    "label_from_table": (
        label_from_table,
        B.with_tables("SELECT slot, post_id, randomised FROM selected", B.POSTS, _COUNTED, _selected_sql("table_scored")),
    ),
    "rescored_table_text": (
        rescored_table_text,
        B.with_tables(_PRINTED_SQL, B.POSTS, B.FEEDBACK, _COUNTED),
    ),
    "label_with_random": (
        label_with_random,
        B.with_tables("SELECT slot, post_id, randomised FROM selected", B.POSTS, B.SCORED, _SELECTED),
    ),
    "label_distinct": (
        label_distinct,
        B.with_tables(
            "SELECT slot, post_id, randomised FROM selected "
            "QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY slot) = 1",
            B.POSTS,
            B.SCORED,
            _SELECTED,
        ),
    ),
    "label_messages": (
        label_messages,
        B.with_tables(
            """SELECT post_id, true AS set_notify, true AS skip_write FROM selected
            UNION ALL SELECT post_id, true, false FROM downloads WHERE error IS NULL""",
            B.POSTS,
            B.SCORED,
            _SELECTED,
            _DOWNLOADS,
        ),
    ),
    "model_scores": (model_scores, None),
    "label_from_model": (label_from_model, None),
    "rescored_text": (rescored_text, None),
}
