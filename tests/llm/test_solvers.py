"""The solvers against what defines them, and the queries of token counts and personal data row by row."""

import copy
import hashlib

import brute
import numpy as np
import pytest
import sentencepiece
from conftest import SF

from feedwatch.llm import quality_classifier, registry, toxicity
from feedwatch.llm.common import table


@pytest.mark.parametrize("share", [0.5, 0.1])
def test_dual_coordinate_descent_closes_the_duality_gap(share):
    """Primal less dual objective of the weights returned is next to nothing."""
    rng = np.random.default_rng(1)
    label = (rng.random(120) < share).astype(int)
    rows = [np.unique(np.concatenate([rng.integers(0, 60, 12), rng.integers(60 + 15 * y, 75 + 15 * y, 3)])) for y in label]
    ratio = np.zeros(1 << quality_classifier.BITS)
    ratio[:100] = rng.normal(size=100)
    weight, b = quality_classifier.dual_coordinate_descent(rows, ratio, label, epochs=3000)
    w = np.divide(weight, ratio, out=np.zeros_like(ratio), where=ratio != 0)
    sign = np.where(label > 0, 1.0, -1.0)
    upper = np.array([min(len(label) / (2 * (label == y).sum()), 10) for y in (0, 1)])[label]
    x = np.zeros((len(rows), 101))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / max(1.0, np.sqrt(len(r)))
    x[:, 100] = 1
    full = np.append(w[:100], b)
    primal = full @ full / 2 + (upper * np.maximum(0, 1 - sign * (x @ full))).sum()
    # plain projected gradient on the dual, as another solver
    k = (x * sign[:, None]) @ (x * sign[:, None]).T
    alpha, before = np.zeros(len(rows)), np.zeros(len(rows))
    rate = 1 / np.linalg.eigvalsh(k)[-1]
    for t in range(20_000):
        ahead = alpha + t / (t + 3) * (alpha - before)
        before, alpha = alpha, np.clip(ahead + rate * (1 - k @ ahead), 0, upper)
    dual = alpha.sum() - alpha @ k @ alpha / 2
    assert dual - 1e-6 <= primal <= dual * 1.001


def test_gradients_equal_differences():
    """One step on one text: each parameter's gradient, told from its step, against the loss's differences."""
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 1 << toxicity.BITS, (12, 3)).astype(np.int32)
    net = toxicity.first_network([ids], np.array([1]))
    net.embedding, net.bias, net.output = (a.astype(float) for a in (net.embedding, net.bias + 0.1, net.output))
    net.filters = [f.astype(float) for f in net.filters]
    net.intercept = 0.2
    learnt = copy.deepcopy(net)
    rate, share = 0.05, 0.5
    toxicity.learn(learnt, [ids], np.array([1]), epochs=1, rate=rate)

    def loss(changed):
        return share * np.log1p(np.exp(-changed.logit(ids)))

    def arrays(n):
        return [n.output, n.bias, *n.filters]

    for which, (old, new) in enumerate(zip(arrays(net), arrays(learnt), strict=True)):
        for at in rng.choice(old.size, 12, replace=False):
            step = (old.flat[at] - new.flat[at]) / rate
            told = step * np.sqrt(1e-2) / np.sqrt(1 - step * step)
            sides = []
            for move in (1e-6, -1e-6):
                moved = copy.deepcopy(net)
                arrays(moved)[which].flat[at] += move
                sides.append(loss(moved))
            assert told == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=1e-5, rel=1e-4)


def test_token_count_query_equals_the_library(spark):
    import public_tokenizers

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    rows = registry.queries()["op6_token_counts"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)


def test_personal_data_query_keeps_the_base_spans(spark):
    kinds = ["email", "ip", "card", "phone"]
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    rows = registry.queries()["op8_personal_data"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = sorted(brute.base_spans(texts[r["doc_id"]] or ""), key=lambda s: (s[1], kinds.index(s[0])))
        named = [f"{k}:{a}:{b}" for k, a, b in base]
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in base) for k in kinds]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(r["spans"].split(","))
