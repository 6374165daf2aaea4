"""The derived tables of ``sources/derived.py`` as SQL, for the oracle queries.

Each constant is a comma-free list of common table expressions; ``with_tables`` joins them.
"""

from __future__ import annotations

from ..functions import text

CLOCK = 1706659200

POSTS = """
posts AS (
  SELECT 'gallery' AS site, doc_id::VARCHAR AS post_id, 'https://x.example/p/' || doc_id AS url,
         source || '/' || lang AS author, lang, source,
         split_part(text, chr(10), 1) AS title,
         CASE WHEN position(chr(10) IN text) > 0
              THEN substr(text, position(chr(10) IN text) + 1) ELSE '' END AS description,
         [lang, source] AS tag_names,
         quality = 1 AND toxic = 0 AS notify
  FROM documents LEFT JOIN labels USING (doc_id))"""

FEEDS = f"""
feeds AS (
  SELECT DISTINCT 'gallery' AS site,
         CASE WHEN user_id % 2 = 0 THEN 'user' ELSE 'tag' END AS feed_type,
         'q' || user_id AS query, user_id % 10 = 0 AS new_feed,
         CASE WHEN user_id % 10 = 0 THEN {CLOCK} - 50000000
              ELSE {CLOCK} - 30 * 86400 + (user_id % 31) * 86400 END AS last_post_time,
         CASE WHEN user_id % 10 = 0 THEN NULL ELSE {CLOCK} - (user_id % 12) * 60 END AS last_query_time
  FROM events)"""

_LISTED = """
listed AS (
  SELECT 'gallery' AS site, CASE WHEN user_id % 2 = 0 THEN 'user' ELSE 'tag' END AS feed_type,
         'q' || user_id AS query, floor(epoch(ts))::BIGINT AS published, event_id,
         (event_id % ((SELECT count(*) FROM documents) * 6 // 5))::VARCHAR AS post_id
  FROM events)"""


def _listing(name: str, poll: str, order: str) -> str:
    return f"""{_LISTED.replace("listed", f"{name}_rows")},
{name}_numbered AS (
  SELECT *, row_number() OVER (PARTITION BY feed_type, query, poll_id ORDER BY {order}) - 1 AS rn,
         count(*) OVER (PARTITION BY feed_type, query, poll_id) AS n
  FROM (SELECT *, {poll} AS poll_id FROM {name}_rows)),
{name} AS (
  SELECT site, feed_type, query, poll_id, rn // 2 AS page, rn % 2 AS pos, post_id,
         'https://x.example/' || event_id AS url, published, published::VARCHAR AS published_time,
         (rn // 2) < ((n - 1) // 2) AS has_more
  FROM {name}_numbered)"""


LISTING = _listing(
    "listing", "(published - 1704067200) // 86400 // 10", "published DESC, event_id DESC"
)
UNORDERED_LISTING = _listing("unordered", "0", "md5(event_id::VARCHAR)")
SCATTERED_LISTING = _listing("scattered", "event_id % 3", "md5(event_id::VARCHAR)")

# Polls with the mark each starts from; then the rows it accepts.
ACCEPTED_CAPPED = """
read_rows AS (
  SELECT * FROM (
    SELECT l.*, min(CASE WHEN NOT has_more THEN page END)
                  OVER (PARTITION BY feed_type, query, poll_id) AS stop_page
    FROM listing l WHERE page < 10)
  WHERE page <= coalesce(stop_page, page)),
marked AS (
  SELECT r.*, f.new_feed, f.last_post_time,
         greatest(f.last_post_time, coalesce(max(r.published) OVER (
           PARTITION BY r.feed_type, r.query ORDER BY r.poll_id
           RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f.last_post_time)) AS mark_before,
         r.poll_id = min(r.poll_id) OVER (PARTITION BY r.feed_type, r.query) AS first_poll
  FROM read_rows r JOIN feeds f USING (site, feed_type, query)),
accepted AS (SELECT * FROM marked WHERE published > mark_before)"""
ACCEPTED = ACCEPTED_CAPPED.replace("FROM listing l WHERE page < 10)", "FROM listing l)")

ENRICHED = """
per_poll AS (
  SELECT site, feed_type, query, poll_id, post_id, min(page * 1000000 + pos) AS place,
         arg_max(url, page * 1000000 + pos) AS url, bool_and(new_feed AND first_poll) AS forced
  FROM accepted GROUP BY ALL),
enriched AS (
  SELECT e.*, p.title, p.description, p.author, p.tag_names
  FROM per_poll e JOIN posts p ON e.post_id = p.post_id)"""

OVERRIDDEN = """
overridden AS (
  SELECT *, CASE WHEN forced THEN
         row_number() OVER (PARTITION BY feed_type, query, poll_id ORDER BY place) <= 5 END AS set_notify
  FROM enriched)"""



def _take_while(poll: int) -> str:
    """One poll of the scattered listing read from the marks that the polls before it left."""
    return f"""
read_{poll} AS (
  SELECT l.*, m.mark AS mark_before, min(CASE WHEN l.published <= m.mark THEN page * 1000000 + pos END)
           OVER (PARTITION BY feed_type, query) AS stop
  FROM scattered l JOIN marks_{poll} m USING (feed_type, query) WHERE l.poll_id = {poll}),
marks_{poll + 1} AS (
  SELECT m.feed_type, m.query, greatest(m.mark, coalesce(max(r.published) FILTER (
           r.stop IS NULL OR r.page * 1000000 + r.pos < r.stop), m.mark)) AS mark
  FROM marks_{poll} m LEFT JOIN read_{poll} r USING (feed_type, query) GROUP BY m.feed_type, m.query, m.mark)"""


#: Polls 0 to 2 one after another: read_n has poll n's rows, its mark and the place of its first old row.
TAKE_WHILE_ROUNDS = "marks_0 AS (SELECT feed_type, query, last_post_time AS mark FROM feeds)," + ",".join(
    _take_while(poll) for poll in range(3)
)

FEEDBACK = """
feedback AS (
  SELECT event_id AS seq, user_id::VARCHAR AS post_id, 'gallery' AS site,
         CASE event_type WHEN 'signup' THEN 'insert' WHEN 'click' THEN 'cb_true'
              WHEN 'error' THEN 'cb_false' WHEN 'view' THEN 'cb_delete'
              WHEN 'purchase' THEN 'cb_print' END AS op
  FROM events)"""




def _served(poll: int) -> str:
    """The live posts after one round: its new posts stored where they don't live yet, then its callbacks."""
    return f"""
round_{poll} AS (
  SELECT post_id, url, title, published AS published_time FROM by_round
  WHERE nth = 1 AND poll_id = {poll} AND post_id NOT IN (SELECT post_id FROM live_{poll})
  UNION ALL SELECT post_id, url, title, published_time FROM live_{poll}),
pressed_{poll} AS (
  SELECT post_id, bool_or(op = 'cb_delete') AS gone,
         arg_max(op = 'cb_true', seq) FILTER (op IN ('cb_true', 'cb_false')) AS label
  FROM parted WHERE part = {poll} GROUP BY post_id),
live_{poll + 1} AS (
  SELECT r.*, coalesce(p.label, l.notify) AS notify
  FROM round_{poll} r LEFT JOIN pressed_{poll} p USING (post_id) LEFT JOIN live_{poll} l USING (post_id)
  WHERE NOT coalesce(p.gone, false))"""


#: live_3: the posts after three rounds of polls, each followed by a third of the callbacks.
SERVED = """
by_round AS (
  SELECT e.*, a.published, row_number() OVER (PARTITION BY e.post_id, e.poll_id
           ORDER BY e.feed_type, e.query, e.place) AS nth
  FROM enriched e JOIN (SELECT feed_type, query, poll_id, post_id, max(published) AS published
                        FROM accepted GROUP BY ALL) a USING (feed_type, query, poll_id, post_id)),
live_0 AS (
  SELECT ''::VARCHAR AS post_id, ''::VARCHAR AS url, ''::VARCHAR AS title, 0::BIGINT AS published_time,
         NULL::BOOLEAN AS notify WHERE false),""" + ",".join(_served(poll) for poll in range(3))
THIRDS = """
parted AS (SELECT *, seq * 3 // (SELECT max(event_id) + 1 FROM events) AS part FROM feedback)"""


def rank_sql(expr: str, salt: str) -> str:
    return f"('0x' || substr(md5({expr}::VARCHAR || ':{salt}'), 1, 12))::BIGINT"


SCORED = f"""
scored AS (SELECT *, ({rank_sql('post_id', 'score')} % 9973) / 9973.0::DOUBLE AS score FROM posts)"""

MESSAGES = """
messages AS (
  SELECT site, post_id, url, notify AS set_notify, lang = 'fr' AS skip_write,
         CASE WHEN description <> '' THEN score END AS score
  FROM scored)"""


def with_tables(body: str, *tables: str) -> str:
    return "WITH " + ",".join(tables) + "\n" + body.strip()


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_TOKEN_PATTERN = text.TOKEN_PATTERN


def decode_entities_sql(expr: str, html: bool = True) -> str:
    """Entities of ``expr`` decoded in one pass (named ones and numeric ones)."""
    names = ", ".join(quote(k) for k in text.entity_map())
    chars = ", ".join(quote(v) for v in text.entity_map().values())
    pattern = quote(text.HTML_ENTITY_PATTERN if html else text.ENTITY_PATTERN)
    named = f"MAP([{names}], [{chars}])"
    body = "rtrim(e[2:], ';')"
    opened = f"regexp_extract(e, {quote('^&(' + '|'.join(text.open_names()) + ')')}, 1)"
    fallback = f"CASE WHEN {opened} <> '' THEN {named}[{opened}] || e[2 + length({opened}):] ELSE e END" if html else "''"
    point = (
        f"CASE WHEN regexp_matches({body}, '^#[xX][0-9A-Fa-f]+$')"
        f" THEN TRY_CAST('0x' || {body}[3:] AS BIGINT)"
        f" WHEN e[2:2] = '#' THEN TRY_CAST({body}[2:] AS BIGINT) END"
    )
    valid = f"({point}) BETWEEN 1 AND 55295 OR ({point}) BETWEEN 57344 AND 1114111"
    key = f"coalesce('#' || ({point}), {body})"
    one = (
        f"coalesce({named}[{key}],"
        f" CASE WHEN {valid} THEN chr(({point})::INT) END, {fallback})"
    )
    return (
        f"(CASE WHEN contains({expr}, '&') THEN array_to_string(list_transform("
        f"list_zip(string_split_regex({expr}, {pattern}), regexp_extract_all({expr}, {pattern})),"
        f" lambda z: z[1] || coalesce(list_transform([z[2]], lambda e: {one})[1], '')), '')"
        f" ELSE {expr} END)"
    )


def strip_html_sql(expr: str, sep: str = "''") -> str:
    return f"regexp_replace({expr}, {quote(text.html_pattern(''))}, {sep}, 'g')"


def tokens_ctes(source: str, id_col: str, blocks: dict[str, str]) -> str:
    """``tokens(id_col, block, tokens)`` over ``source``; ``blocks`` maps block name to prepared text.

    Long runs are cut with a window over the characters, since this dialect has no
    back-references.
    """
    prepared = " UNION ALL ".join(
        f"SELECT {id_col}, {quote(b)} AS block, {e} AS txt FROM {source}" for b, e in blocks.items()
    )
    numeric = quote(f"^{text.numeric_class()}+$")
    return f"""
prepared AS MATERIALIZED ({prepared}),
decoded AS MATERIALIZED (SELECT {id_col}, block, {decode_entities_sql('txt', html=False)} AS txt FROM prepared),
chars AS (
  SELECT {id_col}, block, unnest(cs) AS ch, unnest(range(len(cs))) AS i
  FROM (SELECT {id_col}, block, regexp_extract_all(txt, '(?s).') AS cs FROM decoded)),
runs AS (
  SELECT *, i - row_number() OVER (PARTITION BY {id_col}, block, ch ORDER BY i) AS run FROM chars),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY {id_col}, block, ch, run ORDER BY i) AS k FROM runs),
shortened AS (
  SELECT {id_col}, block, string_agg(ch, '' ORDER BY i) AS txt
  FROM kept WHERE k <= 3 OR regexp_matches(ch, '[a-zA-Z0-9]') GROUP BY ALL),
tokens AS (
  SELECT d.{id_col}, d.block,
         list_transform(regexp_extract_all(coalesce(s.txt, ''), {quote(_TOKEN_PATTERN)}),
           lambda t: CASE WHEN regexp_matches(t, {numeric}) THEN {quote(text.NUMBER_TOKEN)} ELSE t END) AS tokens
  FROM decoded d LEFT JOIN shortened s USING ({id_col}, block))"""


def post_tokens_ctes() -> str:
    description = decode_entities_sql(strip_html_sql("lower(description)"))
    return tokens_ctes("posts", "post_id", {"title": "lower(title)", "description": description})


def grams_ctes() -> str:
    """``counts(post_id, block, term, tf)`` of 1- and 2-grams after stop words, plus tags."""
    words = ", ".join(quote(w) for w in text.default_stop_words())
    return f"""
content AS (
  SELECT post_id, block, list_filter(tokens, lambda t: t NOT IN ({words})) AS ts FROM tokens),
grams AS (
  SELECT post_id, block, unnest(ts || list_transform(range(1, len(ts)),
           lambda i: ts[i] || ' ' || ts[i + 1])) AS term
  FROM content
  UNION ALL SELECT post_id, 'tags', unnest(tag_names) FROM posts),
counts AS (SELECT post_id, block, term, count(*) AS tf FROM grams GROUP BY ALL)"""


VOCAB = """
vocab AS (
  SELECT block, term, count(*) AS df FROM counts GROUP BY ALL
  HAVING block = 'tags'
      OR (count(*) >= 2 AND count(*) <= 0.8::DOUBLE * (SELECT count(*) FROM documents)))"""
