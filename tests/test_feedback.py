from hypothesis import HealthCheck, given, settings, strategies as st

from feedwatch.operators.feedback import apply_feedback, as_log, fold_feedback
from feedwatch.sources import schemas as S

OPS = ["insert", "cb_true", "cb_false", "cb_delete", "cb_print"]


def replay(log):
    state = {}
    for _, op, _, post in sorted(log):
        if op == "insert":
            state.setdefault(post, None)
        elif op == "cb_delete":
            state.pop(post, None)
        elif op in ("cb_true", "cb_false") and post in state:
            state[post] = op == "cb_true"
    return state


def fold(spark, log):
    rows = fold_feedback(spark.createDataFrame(log, S.FEEDBACK)).collect()
    return {r["post_id"]: r["notify"] for r in rows}


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(OPS), st.integers(0, 30)), min_size=1, max_size=200))
def test_fold_equals_sequential_replay(spark, hot_keys, events):
    log = [(seq, op, "gallery", str(post)) for seq, (op, post) in enumerate(events)]
    assert fold(spark, log) == replay(log)


def test_label_after_delete_and_reinsert(spark):
    ops = ["insert", "cb_true", "cb_delete", "cb_true", "insert"]
    assert fold(spark, [(i, op, "gallery", "a") for i, op in enumerate(ops)]) == {"a": None}
    ops = ["insert", "cb_true", "insert"]  # a repeated insert changes nothing
    assert fold(spark, [(i, op, "gallery", "a") for i, op in enumerate(ops)]) == {"a": True}


def test_apply_equals_fold_over_stored_posts(spark):
    posts = spark.createDataFrame(
        [("gallery", "a", True), ("gallery", "b", None), ("gallery", "c", False)],
        "site string, post_id string, notify boolean",
    )
    log = spark.createDataFrame(
        [(1, "cb_false", "gallery", "a"), (2, "cb_delete", "gallery", "b"), (3, "cb_true", "gallery", "b"), (4, "cb_true", "gallery", "x")],
        S.FEEDBACK,
    )
    applied = {r["post_id"]: r["notify"] for r in apply_feedback(posts, log).collect()}
    folded = {r["post_id"]: r["notify"] for r in fold_feedback(as_log(posts).unionByName(log)).collect()}
    assert applied == folded == {"a": False, "c": False}
