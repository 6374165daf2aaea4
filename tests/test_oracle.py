"""Every query with oracle SQL gives the same rows in DuckDB; again with all keys treated as hot."""

import pytest
from compare import difference, oracle
from conftest import SF

from feedwatch.plans import registry

SQL = registry.oracle_sql()
SKEWED = [
    "poll_new_posts",
    "poll_take_while",
    "take_while_rounds",
    "new_feed_override",
    "feedback_state",
    "classify_requests",
    "tfidf_weights",
]


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert len(got) > 0
    assert difference(got, con.execute(SQL[name]).fetchdf()) is None


@pytest.mark.parametrize("name", SKEWED)
def test_matches_oracle_with_hot_keys(spark, con, hot_keys, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert difference(got, con.execute(SQL[name]).fetchdf()) is None


def test_every_query_without_oracle_is_about_the_trained_model():
    assert set(registry.queries()) - set(SQL) == {"model_scores", "label_from_model", "rescored_text"}
