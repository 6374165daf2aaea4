"""The operators' results from plain Python, and tables of awkward rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Extra columns whose names clash with ones the operators make.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, row string, node string, "
    "label string, kind string, size string, words string, `begin` string, held_out string, id string, n_words string"
)


def edge_rows() -> list[tuple]:
    texts = [None, "", " \n\t ", "a", "one two three four", "same text here again please " * 30, "x" * 30_000, "w " * 30_000]
    texts += ["Tab\there é ü 漢字 a@b.cc +1 (988) 555-2485 " * 40, "same text here again please " * 30]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, "no id"), (None, None), (3, "a"), (3, "a")]
    return [(i, t, None, None if k % 3 else "s", None, *(["z"] * 0), None, *["clash"] * 10) for k, (i, t) in enumerate(rows)]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def repeated_words(words: list[str], window: int = 8) -> int:
    starts = defaultdict(list)
    for i in range(len(words) - window + 1):
        starts[tuple(words[i : i + window])].append(i)
    return len({j for at in starts.values() if len(at) > 1 for i in at for j in range(i, i + window)})


def shingles(text: str | None) -> set[tuple]:
    words = WORD.findall(text or "")
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def partition(nodes, edges) -> set[frozenset]:
    """The components of ``nodes`` under ``edges``."""
    group = {n: {n} for n in nodes}
    for a, b in edges:
        if group[a] is not group[b]:
            small, large = sorted((group[a], group[b]), key=len)
            large |= small
            for n in small:
                group[n] = large
    return {frozenset(g) for g in group.values()}


def jaccard_classes(rows: list[tuple]) -> dict[int, tuple]:
    """id -> (class, links) of rows (id, text) with unique ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    common, holders, links = Counter(), defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for ids in holders.values():
        common.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (find(i), links[i]) for i in sets}


def base_spans(text: str) -> list[tuple]:
    patterns = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )
    out = []
    for at, (kind, pattern) in enumerate(patterns):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
            if (
                kind == "email"
                or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                or kind == "card" and 12 <= len(digits) <= 19 and doubled % 10 == 0
                or kind == "phone" and 9 <= len(digits) <= 15
            ):
                out.append((m.start(), at, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def benchmark_hits(text: str | None, items: list[tuple], size: int = 10) -> tuple[int, int, set]:
    words = PLAIN.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        of = PLAIN.findall((body or "").translate(LOWER))
        n = min(size, len(of))
        windows = {tuple(of[i : i + n]) for i in range(len(of) - n + 1)} if of else set()
        for i in range(len(words) - n + 1 if windows else 0):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    return len(words), len(hit), found


def fold(doc_id, folds: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds


def katz(rows: list[tuple], trains, discounts, k: int, tail: float) -> tuple[dict, dict]:
    """Row number -> (tokens, known, base, score); and the sum of probabilities after each history."""
    tokens = [[*WORD.findall((t or "").translate(LOWER)), " end"] for _, t in rows]
    c1, c2, after = Counter(), Counter(), Counter()
    for (doc_id, _), ts in zip(rows, tokens, strict=True):
        if trains(doc_id):
            for h, w in zip([" start", *ts], ts, strict=False):
                c1[w] += 1
                c2[h, w] += 1
                after[h] += 1
    n, v = sum(c1.values()), len(c1)
    d1, d2 = (discounts([float(sum(x == r for x in c.values())) for r in range(1, k + 2)]) for c in (c1, c2))
    kept = lambda c, d: c * d[c - 1] if c <= k else c - tail
    p = {w: kept(c, d1) / n for w, c in c1.items()}
    unknown = 1 - sum(p.values())
    left, seen, total = defaultdict(float), defaultdict(float), defaultdict(float)
    for (h, w), c in c2.items():
        left[h] += (c - kept(c, d2)) / after[h]
        seen[h] += p[w]
        total[h] += kept(c, d2) / after[h]
    for h in total:
        total[h] += left[h] / (1 - seen[h]) * (1 - seen[h])

    def prob(h, w):
        if (h, w) in c2:
            return kept(c2[h, w], d2) / after[h]
        return (left[h] / (1 - seen[h]) if h in after else 1.0) * p.get(w, unknown)

    out = {}
    for i, ts in enumerate(tokens):
        base = sum(math.log10((c1[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts)
        score = sum(math.log10(prob(h, w)) for h, w in zip([" start", *ts], ts, strict=False))
        out[i] = (len(ts), sum(c1[w] > 0 for w in ts), base, score)
    return out, total
