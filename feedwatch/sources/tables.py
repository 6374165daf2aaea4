"""Readers and writers for posts, feeds and landed listings.

Mutable tables are kept as append-only batches (``<path>/batch=<id>``). A batch
folder is overwritten as a whole, so a replayed batch leaves the same contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..conf import shared_dir
from . import schemas as S


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.POST).parquet(path)


def read_listing(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(S.LISTING).load(path)


def stream_listing(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 1
) -> DataFrame:
    """Landed listing files as a stream; the file limit bounds the work in flight."""
    return (
        spark.readStream.format(fmt)
        .schema(S.LISTING)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )


def select_posts(posts: DataFrame, labelled: bool | None = None) -> DataFrame:
    """The columns features need, flattened; optionally only labelled or unlabelled posts."""
    if labelled is not None:
        posts = posts.where(F.col("notify").isNotNull() if labelled else F.col("notify").isNull())
    return posts.select(
        "site",
        "post_id",
        "url",
        "title",
        "description",
        "notify",
        F.col("tags.tag_name").alias("tag_names"),
        F.col("author.username").alias("author"),
    )


def find_post(posts: DataFrame, site: str, post_id: str | Column) -> DataFrame:
    wanted = F.lit(post_id) if isinstance(post_id, str) else post_id
    return posts.where((F.col("site") == site) & (F.col("post_id") == wanted))


def decode_listing_reply(replies: DataFrame, body: str = "body") -> DataFrame:
    """One row per listed post from JSON reply bodies; pages without results carry no rows."""
    decoded = replies.withColumn("_reply", F.from_json(body, S.LISTING_REPLY))
    kept = [c for c in replies.columns if c != body]
    return decoded.select(
        *kept,
        F.col("_reply.has_more").alias("has_more"),
        F.col("_reply.next_offset").alias("next_offset"),
        F.posexplode("_reply.results").alias("pos", "_post"),
    ).select(
        *kept,
        "pos",
        F.col("_post.deviationid").alias("post_id"),
        F.col("_post.url").alias("url"),
        F.col("_post.published_time").alias("published_time"),
        "has_more",
        "next_offset",
    )


def broken_replies(replies: DataFrame, schema: T.StructType, needed: str, body: str = "body") -> DataFrame:
    """The replies that can't be used, with ``reason``: no body, not JSON of this kind, or without the needed field."""
    corrupt = "_broken"
    with_corrupt = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    reply = F.from_json(body, with_corrupt, {"columnNameOfCorruptRecord": corrupt})
    blank = F.col(body).isNull() | (F.trim(body) == "")
    judged = replies.withColumn("_reply", reply)
    reason = (
        F.when(blank, "empty")
        .when(F.col(f"_reply.{corrupt}").isNotNull() | F.col("_reply").isNull(), "not parsed")
        .when(F.col(f"_reply.{needed}").isNull(), f"no {needed}")
    )
    return judged.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*replies.columns, "reason")


def decode_classification(replies: DataFrame, body: str = "body") -> DataFrame:
    """The classifier's answers: its fields, and ``classify_error`` where it failed or can't be read.

    A failed answer has no score, so that ``routing.route`` counts it as failed.
    """
    kept = [c for c in replies.columns if c != body]
    answer = replies.withColumn("_r", F.from_json(body, S.CLASSIFICATION))
    worked = F.coalesce(F.col("_r.success"), F.lit(False)) & F.col("_r.score").isNotNull()
    why = F.when(~worked, F.coalesce("_r.error_description", "_r.error", F.lit("answer not understood")))
    return answer.select(*kept, F.when(worked, F.col("_r.score")).alias("score"), F.when(worked, F.col("_r.notify")).alias("notify"), why.alias("classify_failure"))


def written(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read again: for thin rows that several parts of a plan read."""
    path = shared_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def folder_of(rows: DataFrame) -> str:
    """The folder that ``written`` rows lie in."""
    return rows.inputFiles()[0].rpartition("/")[0]


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_batches(
    spark: SparkSession, path: str, schema: T.StructType, before: int | None = None
) -> DataFrame:
    """All batches of a table, or those written before a batch id (partition-pruned)."""
    with_batch = T.StructType(schema.fields + [T.StructField("batch", T.LongType())])
    df = spark.read.schema(with_batch).option("basePath", path).parquet(path)
    if before is not None:
        df = df.where(F.col("batch") < before)
    return df.drop("batch")
