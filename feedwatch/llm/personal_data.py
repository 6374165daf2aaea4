"""Personal data: base patterns, and a skip-chain conditional random field for the rest.

Base spans come from four patterns with their checks. The field then labels every word of
a text that holds a digit or an ``@``. Its potentials are

* of a word: its shape, its number of digits, the word before it, and whether a base span covers it;
* of neighbours: words that follow each other directly;
* of skip edges: words anywhere in the text whose letters and digits are the same. Each is linked
  to the nearest ones before and after that a base span covers; where no span covers any of them, to the previous one.

Words that a base span covers are observed: they send messages and take none. So a number that is
a phone number in one place is one in the others too, even where it is written so that no pattern
finds it, and each repeat is judged as a single one would be, however many there are and however
far off: repeats of one covered number neither add up nor wear off. Among the other words, loopy
message passing (sum-product) sweeps forward and backward through the text until messages settle;
one sweep carries a message along a whole chain. Words the field is sure of and no base span
covers become added spans, words that follow each other and have one label together.

The potentials are fitted piece by piece, as smoothed log ratios of how often labels
go with features, neighbours and skip edges, counted over a bounded hash sample of the documents with
the base spans as labels. The counts are a small table of fixed kinds, and of word shapes, of which the ``SHAPES``
most frequent count. Fitting and labelling
read whole texts in Spark tasks; nothing is shuffled but those counts.

Nulls and empty texts have no spans. Repeated rows are handled one by one. An empty table
gives an empty result. Extra columns aren't read. All scans are linear in the text's length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANK, map_texts, stored, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# A match never starts inside a run of digits, so the look-behind only keeps the scan linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CANDIDATE = re.compile(r"[0-9@]")
EDGE = ".,;:!?()[]{}<>\"'"
#: Documents the potentials are counted on, at most (about, by a hash of id and text).
SAMPLE = 20_000
#: Word shapes that have a potential, at most: the most frequent ones. All other potentials are of a fixed number.
SHAPES = 20_000
SURE = 0.9
#: Messages have settled when none changes by more. Loops needn't settle: sweeps stop at the given number then.
SETTLED, SWEEPS = 1e-6, 100
#: What a base span adds to its label, and the lack of one to "other".
BASE_WEIGHT, NO_BASE_WEIGHT = 9.0, 3.0

# Words that tell what follows.
CUES = "phone tel call fax mobile mail email contact write ip host server address card visa credit account".split()


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str) -> list[tuple[int, int]]:
    """The words that hold a digit or an ``@``."""
    found, done = [], 0
    m = CANDIDATE.search(text)
    while m:
        start = m.start()
        while start > done and not BLANK.match(text, start - 1):
            start -= 1
        stop = BLANK.search(text, m.end())
        done = stop.start() if stop else len(text)
        found.append((start, done))
        m = CANDIDATE.search(text, done)
    return found


def shape(word: str) -> str:
    """Runs of digits as 9, of letters as a, other signs as they are; a long one is named by its hash."""
    whole = re.sub(r"9+", "9", re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", word)))
    return whole if len(whole) <= 32 else hashlib.md5(whole.encode("utf-8", "surrogatepass")).hexdigest()


def word_before(text: str, at: int) -> str:
    """The whole word that ends before ``at``; it is looked for in twice as many signs until it is found whole."""
    reach = 32
    while True:
        start = max(0, at - reach)
        found = text[start:at].split()
        if start == 0 or len(found) > 1 or (found and text[start].isspace()):
            return found[-1] if found else ""
        reach *= 2


class Graph:
    """The words to label in one text: features, base labels, neighbours and skip edges."""

    def __init__(self, text: str, spans: list[tuple[str, int, int]]):
        self.words = candidates(text)
        self.base = np.zeros(len(self.words), int)
        starts = [a for a, _ in self.words]
        for kind, a, b in reversed(spans):
            k = max(0, bisect_right(starts, a) - 1)
            while k < len(self.words) and self.words[k][0] < b:
                if self.words[k][1] > a:
                    self.base[k] = LABELS.index(kind)
                k += 1
        self.features, self.near, self.skip = [], [], []
        places: dict[str, list[int]] = {}
        for k, (a, b) in enumerate(self.words):
            word = text[a:b].strip(EDGE)
            cue = word_before(text, a).strip(EDGE).lower()
            self.features.append((f"shape {shape(word)}", f"digits {min(20, sum(c.isdigit() for c in word))}", f"cue {cue}" if cue in CUES else "no cue"))
            if k and not text[self.words[k - 1][1] : a].strip():
                self.near.append((k - 1, k))
            key = "".join(c for c in word.lower() if c.isalnum())
            if len(key) >= 3:
                places.setdefault(key, []).append(k)
                if len(places[key]) > 1:
                    self.skip.append((places[key][-2], k))
        #: Skip edges that messages take.
        self.links = [edge for at in places.values() for edge in self.linked(at)]

    def linked(self, places: list[int]) -> list[tuple[int, int]]:
        """Each word of a key with the nearest covered ones on either side; without any, with the previous one."""
        if not self.base[places].any():
            return list(zip(places, places[1:], strict=False))
        found = []
        for way in (places, places[::-1]):
            covered = None
            for k in way:
                if self.base[k]:
                    covered = k
                elif covered is not None:
                    found.append((covered, k))
        return found

    def events(self) -> Counter:
        """What the potentials are counted from."""
        seen: Counter = Counter()
        for names, y in zip(self.features, self.base, strict=True):
            seen.update((f"word\t{n}", int(y)) for n in names)
            seen["label", int(y)] += 1
        for kind, edges in (("near", self.near), ("skip", self.skip)):
            seen.update((kind, int(self.base[i] * len(LABELS) + self.base[j])) for i, j in edges)
        return seen


class Field:
    """Log potentials: of features by label, of neighbours and of skip edges by pair of labels."""

    def __init__(self, counts: dict[tuple[str, int], int]):
        n = len(LABELS)
        of = {name for name, _ in counts}
        total = np.array([counts.get(("label", y), 0) + 1.0 for y in range(n)])
        prior = total / total.sum()
        self.prior = np.log(prior)
        self.word = {}
        for name in of:
            if name.startswith("word\t"):
                c = np.array([counts.get((name, y), 0) for y in range(n)], float)
                self.word[name[5:]] = np.clip(np.log((c + 5 * prior) / (c.sum() + 5) / prior), -4, 4)
        self.edge = {}
        for kind, agree in (("near", 1.0), ("skip", 20.0)):
            c = np.array([counts.get((kind, k), 0) for k in range(n * n)], float).reshape(n, n) + 0.5 + agree * np.eye(n)
            independent = np.outer(c.sum(axis=1), c.sum(axis=0)) / c.sum()
            ratio = np.clip(np.log(c / independent), -6, 6)
            self.edge[kind] = (ratio + ratio.T) / 2

    def unary(self, g: Graph) -> np.ndarray:
        nothing = np.zeros(len(LABELS))
        out = np.array([self.prior / 2 + sum((self.word.get(n, nothing) for n in names), nothing) for names in g.features])
        out -= out.max(axis=1, keepdims=True)
        sure = g.base > 0
        out[sure, g.base[sure]] = BASE_WEIGHT
        out[~sure, 0] += NO_BASE_WEIGHT
        return out

    def marginals(self, g: Graph, sweeps: int = SWEEPS) -> np.ndarray:
        """Loopy sum-product: P(label) of each word."""
        belief = self.unary(g)
        observed, free = [], []
        for kind, edges in (("near", g.near), ("skip", g.links)):
            for i, j in edges:
                if not g.base[i] and not g.base[j]:
                    free.append((i, j, self.edge[kind]))
                elif not g.base[i] or not g.base[j]:
                    observed.append((i, j, self.edge[kind]) if g.base[i] else (j, i, self.edge[kind]))
        if observed:
            source, goal = (np.array([e[k] for e in observed]) for k in (0, 1))
            sent = message(belief[source], np.stack([e[2] for e in observed]))
            np.add.at(belief, goal, sent)
        # Forward by the earlier word, backward by the later one: what a word sends on, it has received before.
        forward = sorted(range(len(free)), key=lambda e: free[e][0])
        backward = sorted(range(len(free)), key=lambda e: -free[e][1])
        sent = np.zeros((2, len(free), len(LABELS)))
        for _ in range(sweeps if free else 0):
            moved = 0.0
            for way, order in enumerate((forward, backward)):
                for e in order:
                    i, j, potential = free[e]
                    if way:
                        i, j = j, i
                    new = message(belief[i] - sent[1 - way, e], potential)
                    change = new - sent[way, e]
                    moved = max(moved, np.abs(change).max())
                    belief[j] += change
                    sent[way, e] = new
            if moved < SETTLED:
                break
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def message(belief: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """What a word (or each of many) with this belief sends along an edge with this (symmetric) potential."""
    x = belief[..., None, :] + potential
    top = x.max(axis=-1, keepdims=True)
    new = (top + np.log(np.exp(x - top).sum(axis=-1, keepdims=True)))[..., 0]
    return new - new.max(axis=-1, keepdims=True)


def added_spans(text: str, g: Graph, field: Field) -> list[tuple[str, int, int]]:
    """Words the field is sure of and no base span covers; neighbours of one label together."""
    p = field.marginals(g)
    best = p.argmax(axis=1)
    best[(p.max(axis=1) < SURE) | (g.base > 0)] = 0
    near, out = set(g.near), []
    for k in np.flatnonzero(best):
        a, b = g.words[k]
        word = text[a:b]
        a += len(word) - len(word.lstrip(EDGE))
        b -= len(word) - len(word.rstrip(EDGE))
        if a >= b:
            continue
        kind = LABELS[best[k]]
        if out and (k - 1, k) in near and best[k - 1] == best[k]:
            out[-1] = (kind, out[-1][1], b)
        else:
            out.append((kind, a, b))
    return out


def write(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(text: str | None, field: Field) -> tuple[list, list]:
    """Base spans and added spans of one whole text."""
    if not text:
        return [], []
    base = base_spans(text)
    g = Graph(text, base)
    return base, added_spans(text, g, field) if len(g.words) > (g.base > 0).sum() else []


def sampled(docs: DataFrame, text: str, sample: int, doc_id: str) -> DataFrame:
    n = docs.count()
    share = min(1.0, sample / max(1, n))
    return docs.select(text).where(F.pmod(F.xxhash64(doc_id, text), F.lit(1_000_000)) < int(share * 1_000_000))


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE, doc_id: str = "doc_id", shapes: int = SHAPES) -> Field:
    """Potentials from about ``sample`` documents at most, with those of the ``shapes`` most frequent word shapes.

    Texts that many documents share are sampled document by document, by their ids.
    """
    chosen = sampled(docs, text, sample, doc_id)
    event = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.IntegerType()), T.StructField("times", T.LongType())])

    def start():
        def count(texts):
            seen = [Graph(t, base_spans(t)).events() if t else {} for t in texts]
            return [[[{"name": n, "value": v, "times": c} for (n, v), c in s.items()] for s in seen]]

        return count

    made = map_texts(chosen, T.StructType([T.StructField("events", T.ArrayType(event))]), start, text)
    totals = made.select(F.inline("events")).groupBy("name", "value").agg(F.sum("times").alias("times"))
    totals = stored(totals, "events")
    is_shape = F.startswith("name", F.lit("word\tshape"))
    by_shape = totals.where(is_shape).groupBy("name").agg(F.sum("times").alias("n")).where("n >= 3").orderBy(F.desc("n"), "name").limit(shapes)
    kept = totals.where(~is_shape).unionAll(totals.join(by_shape.select("name"), "name", "left_semi"))
    return Field({(r["name"], r["value"]): r["times"] for r in kept.collect()})


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def personal_data(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with base and spans (arrays of kind, begin, end) and redacted, instead of the text."""

    def start():
        def label(texts):
            found = [find(t, field) for t in texts]
            every = [sorted(b + a, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) for b, a in found]
            named = lambda spans: [[{"kind": k, "begin": a, "end": b} for k, a, b in s] for s in spans]
            return [named(b for b, _ in found), named(every), [redact(t, s) for t, s in zip(texts, every, strict=True)]]

        return label

    return map_texts(docs, T.StructType([T.StructField("base", SPAN), T.StructField("spans", SPAN), T.StructField("redacted", T.StringType())]), start, text)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each stretch of overlapping spans replaced by the first one's kind."""
    if not spans:
        return text
    out, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def number_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data(docs, train(docs))
    counts = [number_of(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op8_personal_data": (op8_personal_data, None)}
