"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. Targets. Sources in code point order, null last, take the weights in turn and share
   all words by weight. A target stops at ``repeats`` times its source's words; the
   excess goes to the others by weight, until none is above. With sources ordered by
   the level at which they fill up, the common level is the largest of one running
   quotient, so there is no loop.
2. Quotas. The mix is cut into blocks of equal words. Blocks go one by one to the
   source with the highest quotient target / (2 k + 1), k being the blocks it has; then a
   source's blocks go to its shards in the same way by their words. Only seats near the
   fair share can be in doubt, so only about as many quotients as there are parties are
   compared, however many blocks there are.
3. Selection. Documents of a shard lie end to end in the order of a seeded hash. A shard
   takes its quota as a run of blocks from a seeded start, going round as often as the
   quota needs. Who takes part in a pass is thus a seeded choice, and a document takes
   at most ``repeats`` times its words.

Shards hold about ``SHARD_WORDS`` words each, so a hot source has many shards and no
window holds a whole source's documents. A document's place comes from its id and its text, so rows
without an id, or with one and the same, are spread as others are. The windows over sources and over the shards
of a source see one row for each of them. Text is read once, for the sizes; what is
stored and shuffled is an id, a source and a number.

A null text has size 0 and takes 0. Null sources are one source. Repeated rows are
separate documents; rows alike in id, source and size are interchangeable. An empty table
gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, stored, table

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK_WORDS = 16
SHARD_WORDS = 2_000_000
SEED = "mix"


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, no_source, size (words) and mark (a hash of the text) of every document."""
    words = F.regexp_count(F.col(text), F.lit(WORD_PATTERN))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.col(source).isNull().alias("no_source"),
        F.coalesce(words, F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("mark"),
    )


def hashed(*parts: Column) -> Column:
    """A seeded number below 2^32."""
    text = F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """no_source, source, source_size and target of every source."""
    by = sized.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"))
    at = (F.row_number().over(Window.orderBy("no_source", "source")) - 1) % len(weights)
    weight = F.get(F.array(*[F.lit(w) for w in weights]), at)
    by = by.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * repeats)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "source")
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    all_words = F.sum("source_size").over(Window.partitionBy())
    by = by.withColumn("__level", (all_words - before) / rest)
    level = F.max("__level").over(Window.partitionBy())
    target = F.least(F.col("cap").cast("double"), level * F.col("weight"))
    return by.select("no_source", "source", "source_size", target.alias("target"))


def apportion(parties: DataFrame, within: list[str], order: list[str], value: str, seats: str) -> DataFrame:
    """``parties`` with quota: the ``seats`` of each group given out by highest value / (2 k - 1).

    Every divisor that hands out the right number of seats lies within n / 2 seats of
    total / seats, for n parties. Seats below that band are certain, seats above it
    impossible; those inside are ranked, ties in ``order``.
    """
    group = Window.partitionBy(*within)
    total, n = F.sum(value).over(group), F.count(F.lit(1)).over(group)
    fair = F.when(total > 0, F.col(value) * F.col(seats) / total).otherwise(0.0)
    band = F.when(F.col(seats) > 0, n / (2.0 * F.col(seats))).otherwise(0.0)
    sure = F.greatest(F.lit(0), F.floor(fair * (1 - band) + 0.5) - 1)
    most = F.when(total > 0, F.floor(fair * (1 + band) + 0.5) + 1).otherwise(0)
    banded = parties.withColumns({"__sure": sure.cast("long"), "__most": most.cast("long")})
    banded = banded.withColumn("__open", F.col(seats) - F.sum("__sure").over(group))
    doubtful = banded.where("__most > __sure").select("*", F.explode(F.sequence(F.col("__sure") + 1, F.col("__most"))).alias("__seat"))
    quotient = F.col(value) / (2 * F.col("__seat") - 1)
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(quotient.desc(), *order))
    won = doubtful.withColumn("__won", (rank <= F.col("__open")).cast("long"))
    won = won.groupBy(*within, *order).agg(F.sum("__won").alias("__won"))
    joined = banded.join(won, [*within, *order], "left")
    quota = F.col("__sure") + F.coalesce(F.col("__won"), F.lit(0))
    return joined.withColumn("quota", quota).drop("__sure", "__most", "__open", "__won")


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``sized`` with source_size, target, shard and taken.

    ``sized`` is read three times: give a stored table.
    """
    keys = ["no_source", "source"]
    aimed = targets(sized, weights, repeats)
    all_blocks = F.floor(F.sum("source_size").over(Window.partitionBy()) / block_words + 0.5)
    aimed = aimed.withColumn("__all", F.lit("")).withColumn("blocks", all_blocks)
    aimed = apportion(aimed, ["__all"], keys, "target", "blocks").drop("__all", "blocks")
    aimed = aimed.withColumnRenamed("quota", "source_quota").withColumn("shards", F.ceil((F.col("source_size") + 1) / shard_words))
    placed = sized.withColumn("place", hashed(F.col("doc_id"), F.col("mark")))
    # dealt by shard at once: a partitioning by source would put a hot source's documents in one task
    placed = placed.join(aimed, keys).withColumn("shard", F.col("place") % F.col("shards")).repartition(*keys, "shard")
    shards = placed.groupBy(*keys, "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("source_quota"))
    shards = apportion(shards, keys, ["shard"], "words", "source_quota")
    asked = F.least(F.col("quota") * block_words, F.col("words") * repeats)
    first = hashed(F.lit("start"), F.col("source"), F.col("shard")) % F.ceil(F.col("words") / block_words) * block_words
    shards = shards.select(*keys, "shard", "words", asked.alias("asked"), first.alias("first")).where("words > 0")
    line = Window.partitionBy(*keys, "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("end", F.sum("size").over(line)).withColumn("begin", F.col("end") - F.col("size"))
    passes = F.floor(F.col("asked") / F.col("words"))
    stop = F.col("first") + F.col("asked") % F.col("words")

    def overlap(start: Column, end: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("end"), end) - F.greatest(F.col("begin"), start))

    part = overlap(F.col("first"), stop) + overlap(F.lit(0), stop - F.col("words"))
    taken = F.coalesce(passes * F.col("size") + part, F.lit(0)).cast("long")
    return laid.join(shards, [*keys, "shard"], "left").select(
        "doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target", "shard", taken.alias("taken")
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(stored(sizes(table(spark, sf_dir, "documents")), "mix"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def _apportion_sql(name: str, parties: str, within: str, order: str, value: str, seats: str) -> str:
    return f"""
{name}_0 AS (
  SELECT *, sum({value}) OVER g AS total, count(*) OVER g AS n FROM {parties} WINDOW g AS (PARTITION BY {within})),
{name}_1 AS (
  SELECT *, CASE WHEN total > 0 THEN {value} * {seats} / total ELSE 0.0::DOUBLE END AS fair,
         CASE WHEN {seats} > 0 THEN n / (2.0::DOUBLE * {seats}) ELSE 0.0::DOUBLE END AS band FROM {name}_0),
{name}_2 AS (
  SELECT *, greatest(0, floor(fair * (1 - band) + 0.5::DOUBLE) - 1)::BIGINT AS sure,
         CASE WHEN total > 0 THEN floor(fair * (1 + band) + 0.5::DOUBLE) + 1 ELSE 0 END::BIGINT AS most FROM {name}_1),
{name}_3 AS (
  SELECT *, {seats} - sum(sure) OVER (PARTITION BY {within}) AS open FROM {name}_2),
{name}_4 AS (
  SELECT *, unnest(range(sure + 1, most + 1)) AS seat FROM {name}_3),
{name}_5 AS (
  SELECT *, (row_number() OVER (PARTITION BY {within} ORDER BY {value} / (2 * seat - 1)::DOUBLE DESC, {order}) <= open)::BIGINT AS won FROM {name}_4),
{name}_6 AS (SELECT {within}, {order}, sum(won) AS won FROM {name}_5 GROUP BY ALL),
{name} AS (
  SELECT p.*, p.sure + coalesce(w.won, 0) AS quota FROM {name}_3 p LEFT JOIN {name}_6 w USING ({within}, {order}))"""


def mix_ctes(docs: str = "documents") -> str:
    """DuckDB: mixed(doc_id, source, size, source_size, target, taken) from ``docs``."""
    return f"""
sized AS (
  SELECT doc_id, coalesce(source, '') AS source, source IS NULL AS no_source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS mark FROM {docs}),
sums AS (SELECT no_source, source, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
by_source AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY no_source, source) - 1) % 3] AS weight FROM sums),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(3 * source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
         / (sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM by_source WINDOW f AS (ORDER BY (3 * source_size)::DOUBLE / weight, no_source, source)),
aimed AS (
  SELECT no_source, source, source_size, least((3 * source_size)::DOUBLE, max(level) OVER () * weight) AS target,
         floor((sum(source_size) OVER ())::DOUBLE / {BLOCK_WORDS} + 0.5)::BIGINT AS blocks, '' AS everything FROM levels),
{_apportion_sql("by_quota", "aimed", "everything", "no_source, source", "target", "blocks")},
placed AS (
  SELECT d.doc_id, d.no_source, d.source, d.size, q.source_size, q.target, q.quota AS source_quota,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || mark), 1, 8))::BIGINT AS place,
         place % ceil((q.source_size + 1)::DOUBLE / {SHARD_WORDS})::BIGINT AS shard
  FROM sized d JOIN by_quota q USING (no_source, source)),
shards AS (
  SELECT no_source, source, shard, sum(size)::BIGINT AS words, max(source_quota)::BIGINT AS source_quota FROM placed GROUP BY ALL),
{_apportion_sql("quotas", "shards", "no_source, source", "shard", "words", "source_quota")},
runs AS (
  SELECT no_source, source, shard, words, least(quota * {BLOCK_WORDS}, words * 3)::BIGINT AS asked,
         ('0x' || substr(md5('{SEED}:start:' || source || ':' || shard), 1, 8))::BIGINT
           % ceil(words::DOUBLE / {BLOCK_WORDS})::BIGINT * {BLOCK_WORDS} AS first
  FROM quotas WHERE words > 0),
laid AS (
  SELECT *, (sum(size) OVER (PARTITION BY no_source, source, shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS "end" FROM placed),
mixed AS (
  SELECT doc_id, CASE WHEN NOT no_source THEN source END AS source, size, source_size, target, coalesce(
      (asked // words) * size
      + greatest(0, least("end", first + asked % words) - greatest("end" - size, first))
      + greatest(0, least("end", first + asked % words - words) - greatest("end" - size, 0)), 0)::BIGINT AS taken
  FROM laid LEFT JOIN runs USING (no_source, source, shard))"""


SQL = f"WITH {mix_ctes()} SELECT doc_id, size, source_size, target, taken FROM mixed"

QUERIES = {"op2_mixing": (op2_mixing, SQL)}
