"""Quality rules as weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0) on a document. How far each rule can
be trusted isn't given: expectation-maximisation estimates, for both classes, how often
each rule casts each vote, together with the share of good documents. A document is
kept by its posterior probability of being good, not by passing every rule.

The estimates need only how many documents cast each combination of votes. There are at
most 3^rules combinations whatever the size of the corpus, so the counts over all
documents come to the driver and the posterior goes back as a column expression: no
document is left out of the estimates and nothing grows.

Nulls and empty texts have no words, so all figures are 0 and every rule but the one on
length abstains. Repeated rows are separate documents. An empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, map_texts, stored, table

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Figures that only the rules use.
MORE = ("n_lines", "n_upper", "n_letters", "n_shouts", "n_echoes", "n_marked")
ADDED = T.StructType([T.StructField(c, T.LongType()) for c in FIGURES + MORE])


@dataclass(frozen=True)
class Rule:
    """Votes bad above (or below) one limit, good beyond the other, abstains between them."""

    name: str
    value: str
    good: float
    bad: float

    def vote(self) -> Column:
        value = F.expr(self.value)
        good, bad = value <= self.good, value >= self.bad
        if self.good > self.bad:
            good, bad = value >= self.good, value <= self.bad
        return F.when(F.col("n_words") == 0, 0).when(bad, -1).when(good, 1).otherwise(0)


def share(part: str, whole: str) -> str:
    return f"{part} / greatest({whole}, 1)"


#: The rules; each value is a share, so that a rule means the same for short and long texts.
RULES = (
    Rule("length", "n_words", 40, 20),
    Rule("symbols", share("n_symbols", "n_words"), 0.02, 0.2),
    Rule("marked words", share("n_marked", "n_words"), 0.02, 0.3),
    Rule("repeated lines", share("n_dup_lines", "n_lines"), 0.05, 0.5),
    Rule("repeated windows", share("n_repeat_words", "n_words"), 0.05, 0.3),
    Rule("same word again", share("n_echoes", "n_words"), 0.03, 0.3),
    Rule("capitals", share("n_upper", "n_letters"), 0.2, 0.6),
    Rule("shouts", share("n_shouts", "n_words"), 0.02, 0.2),
    Rule("word length", f"abs({share('word_chars', 'n_words')} - 6.0)", 3.0, 6.0),
)


def repeated_words(found: list[str]) -> int:
    """Words inside windows of eight words that occur twice or more, the first included.

    Windows are compared exactly: numbers of words, then of pairs, fours and eights.
    """
    n = len(found)
    if n <= WINDOW:
        return 0
    first: dict[str, int] = {}
    ids = np.fromiter(map(first.setdefault, found, range(n)), np.int64, n)
    if len(first) == n:
        return 0
    width = 1
    while width < WINDOW:
        pairs = ids[:-width] * n + ids[width:]
        kinds, ids, times = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(kinds) == len(pairs):
            return 0
        width *= 2
    starts = np.flatnonzero(times[ids] > 1)
    edges = np.zeros(n + 1, np.int64)
    edges[starts] += 1
    edges[starts + WINDOW] -= 1
    return int((np.cumsum(edges[:n]) > 0).sum())


def figures(text: str | None) -> tuple[int, ...]:
    """FIGURES and MORE of one whole text."""
    if not text:
        return (0,) * (len(FIGURES) + len(MORE))
    found = WORD.findall(text)
    word_chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    lines = again = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            again += line in seen
            seen.add(line)
    upper = letters = marked = 0
    echoes = sum(a == b for a, b in zip(found, found[1:], strict=False))
    for w in found:
        letters += w[:1].isalpha()
        upper += len(w) > 1 and w.isupper()
        marked += not w[-1:].isalnum() and w[-1] not in ".,;:?!\"')]»”’…"
    return (len(found), word_chars, symbols, again, repeated_words(found), lines, upper, letters, text.count("!"), echoes, marked)


def document_figures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    def start():
        return lambda texts: list(zip(*map(figures, texts), strict=True))

    return map_texts(docs.select(doc_id, text), ADDED, start, text)


@dataclass
class Model:
    """P(good), and the log of P(vote | class) of each rule: log[rule, class, vote + 1]."""

    good: float
    log: np.ndarray

    def accuracy(self) -> list[float]:
        """Of each rule's votes, the share that the model holds right."""
        p, prior = np.exp(self.log), (1 - self.good, self.good)
        right = prior[0] * p[:, 0, 0] + prior[1] * p[:, 1, 2]
        wrong = prior[0] * p[:, 0, 2] + prior[1] * p[:, 1, 0]
        return list(right / (right + wrong))

    def posterior(self, votes: list[Column]) -> Column:
        """P(good | votes)."""
        odds = F.lit(math.log(self.good) - math.log(1 - self.good))
        for j, v in enumerate(votes):
            bad, none, good = (float(x) for x in self.log[j, 1] - self.log[j, 0])
            odds = odds + F.when(v < 0, bad).when(v > 0, good).otherwise(none)
        return 1 / (1 + F.exp(-odds))


def fit(votes: np.ndarray, times: np.ndarray, rounds: int = 200, doubt: float = 2.0) -> Model:
    """Expectation-maximisation over combinations of votes and how many documents cast each.

    It starts from doubt about every document that any rule votes bad, since the rules look
    for different faults and a poor document seldom has more than one. ``doubt`` pseudo-votes by class, four fifths of
    them right, keep rules that hardly vote from taking an extreme accuracy.
    """
    rules = votes.shape[1] if votes.ndim == 2 else len(RULES)
    votes = votes.reshape(-1, rules)
    p = np.where((votes < 0).any(axis=1), 0.1, 0.9)
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    prior = doubt * np.array([[0.4, 0.5, 0.1], [0.1, 0.5, 0.4]])
    good, log = 0.5, np.zeros((rules, 2, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - p) * times, p * times])
        counts = np.einsum("kn,nrv->rkv", weight, onehot) + prior
        log = np.log(counts / counts.sum(axis=2, keepdims=True))
        good = float((weight[1].sum() + 1) / (times.sum() + 2))
        margin = np.log(good) - np.log(1 - good) + np.einsum("nrv,rv->n", onehot, log[:, 1] - log[:, 0])
        new = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        if len(p) == 0 or np.abs(new - p).max() < 1e-9:
            break
        p = new
    return Model(good, log)


def judge(figured: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> tuple[DataFrame, Model]:
    """``figured`` with quality (the posterior) and base_failed and kept; the model too.

    ``figured`` is read twice: give a stored table.
    """
    names = [f"__vote_{j}" for j in range(len(rules))]
    voted = figured.select("*", *[r.vote().alias(n) for r, n in zip(rules, names, strict=True)])
    cast = voted.groupBy(*names).count().collect()
    votes = np.array([[r[n] for n in names] for r in cast], dtype=int).reshape(-1, len(rules))
    model = fit(votes, np.array([r["count"] for r in cast], dtype=float))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = voted.withColumn("quality", model.posterior([F.col(n) for n in names])).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop(*names), model


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    figured = stored(document_figures(table(spark, sf_dir, "documents")), "quality")
    judged, _ = judge(figured)
    return judged.select("doc_id", *FIGURES, "base_failed", "kept", "quality")


QUERIES = {"op1_quality_rules": (op1_quality_rules, None)}
