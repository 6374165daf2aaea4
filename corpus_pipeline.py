"""A corpus from raw documents: toxic ones out, copies out, benchmark passages out, personal data masked, sources mixed.

Each stage takes all documents its predecessor kept and returns documents (all columns
of the table, whatever they are), written as Parquet and read again as the next one's
input; the last returns the mix: which document is taken for how many words.

Every stage keeps documents with null ids and null texts, keeps repeated rows apart unless
said otherwise, and gives an empty result for an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedwatch.llm import decontamination, jaccard_join, mixing, personal_data, toxicity
from feedwatch.llm.common import WORD_PATTERN, fold, stored, table


def row_key() -> Column:
    """Tells documents apart by id and text, nulls included; a null text isn't an empty one."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.md5("text"), F.lit("null")))


def keyed(docs: DataFrame) -> DataFrame:
    """(key, row): the documents as one column beside their key, so that no column's name can clash."""
    return docs.select(row_key().alias("key"), F.struct(*docs.columns).alias("row"))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", toxicity.FOLDS) != toxicity.HELD_OUT)
    net = toxicity.train(docs, labels, "doc_id", "toxic")
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("text").alias("__text"))
    scored = toxicity.score(renamed, net, "__text").where(F.col("score") < toxicity.THRESHOLD)
    return scored.select(*[F.col(n).alias(c) for c, n in names.items()])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of exact and near copies: the smallest id. Rows alike in id and text are one.

    Of such rows the one with the smallest other columns stays, compared in the table's order as text, nulls first.
    Texts without a word are copies of nothing: all their rows stay.
    """
    classes = jaccard_join.jaccard_classes(docs)
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lower(F.hex("node")))
    kept = classes.where("first").select(key.alias("key"))
    has_word = F.coalesce(F.col("text").rlike(WORD_PATTERN), F.lit(False))
    # values that can't be ordered, as maps, are compared as they are written
    order = F.array(*[F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")], F.lit(""))
    worded = docs.where(has_word)
    ordered = worded.select(row_key().alias("key"), F.struct(*docs.columns).alias("row"), order.alias("order"))
    firsts = ordered.join(kept, "key", "left_semi").groupBy("key").agg(F.min_by("row", "order").alias("row"))
    return firsts.select("row.*").unionByName(docs.where(~has_word))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    texts = docs.select(row_key().alias("key"), "text")
    hit = decontamination.contaminated(texts, table(spark, sf_dir, "benchmark"), "key").where("n_hit > 0")
    return keyed(docs).join(hit.select("key"), "key", "left_anti").select("row.*")


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts replaced by its kind; n_chars follows."""
    field = personal_data.train(docs)
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(c).alias(n) for c, n in names.items() if c != "text"], F.col("text").alias("__text"))
    found = personal_data.personal_data(renamed, field, "__text")
    made = {"text": F.col("redacted"), "n_chars": F.coalesce(F.length("redacted").cast("long"), F.col(names["n_chars"]))}
    return found.select(*[made.get(c, F.col(n)).alias(c) for c, n in names.items()])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of the documents that the mix takes."""
    mix = mixing.mix(stored(mixing.sizes(docs), "mix"))
    return mix.where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", without_copies),
    ("benchmark decontamination", without_benchmark),
    ("personal data", masked),
    ("mixing sources", mixed),
]

#: The classifier, the field and the forest have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
