"""Poll rounds landed several at a time: the same store as by SQL, and a bounded number of micro-batches."""

import duckdb
from compare import difference
from pyspark.sql import functions as F

from feedwatch.plans import feeds

ROUNDS = 5
QUERIES = ("stream_messages", "stream_feeds", "stream_ingest")


def tables(spark, path):
    """Events of eleven users over many ten-day rounds, and posts for most of them."""
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 86400 * 10 * ROUNDS / 200)
    events = spark.range(200).select(
        F.col("id").alias("event_id"), ts.alias("ts"), ((F.col("id") * 7) % 30 % 11).alias("user_id"), F.lit("view").alias("event_type"),
        F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
    )
    documents = spark.range(40).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("title"), "id", F.lit("\ntext")).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(9).cast("long").alias("n_chars"),
    )
    labels = spark.range(10).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    for name, rows in (("events", events), ("documents", documents), ("labels", labels)):
        rows.write.parquet(f"{path}/{name}.parquet")


def test_rounds_land_together_and_give_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "LANDINGS", 2)
    tables(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name, columns in (("events", "* REPLACE (ts::TIMESTAMP AS ts)"), ("documents", "*"), ("labels", "*")):
        con.execute(f"CREATE VIEW {name} AS SELECT {columns} FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name in QUERIES:
        got = feeds.QUERIES[name][0](spark, str(tmp_path)).toPandas()
        assert len(got) > 0
        assert difference(got, con.execute(feeds.QUERIES[name][1]).fetchdf()) is None
    store = feeds._streamed(spark, str(tmp_path))
    assert store.feed_table.last() == 1  # batches 0 and 1, of five rounds


def test_landings_keep_every_round_in_order():
    for n in (0, 1, 3, 8, 9, 180):
        groups = feeds._landings(list(range(n)))
        assert [r for g in groups for r in g] == list(range(n))
        assert len(groups) == min(n, feeds.LANDINGS) and all(groups)
