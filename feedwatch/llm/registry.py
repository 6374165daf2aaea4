"""The operators' queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontamination, jaccard_join, katz, merkle, mixing, personal_data, quality_classifier, quality_rules, sharding, token_counts, toxicity, url_filter

_ALL = {**centroids.QUERIES, **decontamination.QUERIES, **jaccard_join.QUERIES, **katz.QUERIES, **merkle.QUERIES, **mixing.QUERIES, **personal_data.QUERIES, **quality_rules.QUERIES, **quality_classifier.QUERIES, **sharding.QUERIES, **token_counts.QUERIES, **toxicity.QUERIES, **url_filter.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
