"""Katz back-off language model over word pairs, counted and evaluated where the counts are.

The model. Words are lower-cased runs, every text ends with an end token and starts after
a start. With training counts c, a pair seen has probability d(c) c(hw) / c(h), a word not
seen after a known h has alpha(h) P(w), and after an unknown h it has P(w). P(w) is d(c) c(w) / N,
and what the discounts leave goes to the class of unknown words. d is the Good-Turing discount for
counts up to ``K`` and takes a constant ``TAIL`` off every larger count, so that each
history leaves some mass. alpha(h) is exact: the mass that h's pairs leave, divided by one less the
sum of P over the words seen after h. So the probabilities after each h, unknown word included, sum to 1.

The computation. A text's score is a sum over its tokens, and almost all of a token's term
is known wherever its word's counts are. Blocks of texts are sent, as distinct pairs with
the numbers of their texts, to the part that owns the word: this one shuffle of pairs brings
together c(w), c(hw) and every text that asks for them. Each part returns

* sums for each text, by count class, so that discounts, which need the counts of counts of all
  parts, are applied afterwards;
* for each history, how its pairs fall into count classes: the table of back-off weights;
* for each pair that training lacks, its text and history, to be joined with that table;
* counts of counts.

They are stored as one table partitioned by kind. Score and table grow with the corpus.

Hot words. A word or pair with a share of the tokens above ``SHARE`` is counted exactly
beforehand; there are about 1 / SHARE such words and pairs at most whatever the corpus, so their counts are
broadcast. A hot pair never leaves its block, and the other pairs of a hot word are dealt by
the pair instead of the word, since c(w) is known everywhere. So no key's tokens meet in one
task; parts grow in number with the tokens.

Null and empty texts have the end token alone. Repeated rows train and are scored one by one.
A null id counts as empty text in the fold. With nothing to learn from, all words are unknown
with probability 1. An empty table gives an empty result. Extra columns aren't read. Words are
compared by 64-bit hashes, histories by 48 of these bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, stored, table

FOLDS = 5
HELD_OUT = 1
#: Good-Turing discounts up to this count; above, TAIL is taken off.
K = 5
TAIL = 0.1
SHARE = 1e-5
#: Hot keys are looked for in one of so many texts.
SAMPLED = 16
#: Hot words and pairs occur at least so often, which keeps their counts above K.
HOT_LEAST = 1000
BLOCK_TOKENS = 1_000_000
#: Bytes of text that are hashed at once; only a single word may be longer.
PIECE_BYTES = 1 << 20
PART_TOKENS = 2_000_000
#: A part is worked on in so many slices of its words.
SLICES = 16
#: Hashes no word has: a word's hash that falls on one of them moves on.
START, END = 1, 2
#: Histories are told apart by so many bits of their hash; words by all 64.
HISTORY_BITS = np.uint64((1 << 48) - 1)

TEXT = [f"d{k}" for k in range(6 + 2 * K)]  # see Sums


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (h ^ (w >> np.uint64(31)) ^ (w << np.uint64(33))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Block:
    """Texts of about BLOCK_TOKENS tokens: h, w and text number of each token."""

    def __init__(self):
        self.parts, self.lengths, self.rows, self.ids, self.train, self.tokens = [], [], [], [], [], 0

    def add(self, row: int, doc_id: int | None, train: bool, hashed: np.ndarray) -> None:
        self.parts.append(np.concatenate([hashed, [np.uint64(END)]]))
        self.lengths.append(len(hashed) + 1)
        self.rows.append(row)
        self.ids.append(doc_id)
        self.train.append(train)
        self.tokens += len(hashed) + 1

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """h, w, text number, and whether the text is for training."""
        w = np.concatenate(self.parts)
        h = np.concatenate([[np.uint64(START)], w[:-1]])
        lengths = np.array(self.lengths)
        h[np.cumsum(lengths)[:-1]] = START
        return h, w, np.repeat(np.arange(len(lengths)), lengths), np.array(self.train, bool)


class WordBytes:
    """64-bit hashes of the words of UTF-8 texts, A-Z lower-cased, computed for whole arrays of bytes at a time.

    A word's hash is the sum of a random number for each byte times a power of an odd base, modulo 2^64. Running sums
    over all bytes give the sum of any range, and a power of the base's inverse moves it to the range's start.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.of_byte = np.random.default_rng(9).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.of_byte[ord("A") : ord("Z") + 1] = self.of_byte[ord("a") : ord("z") + 1]
        self.blank = np.zeros(256, bool)
        self.blank[[0x20, *range(0x09, 0x0E)]] = True
        self.powers = self.inverses = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.powers):
            size = max(n, 2 * len(self.powers))
            factors = np.full(size, 1, np.uint64)
            factors[1:] = self.BASE
            self.powers = np.cumprod(factors)
            factors[1:] = pow(self.BASE, -1, 1 << 64)
            self.inverses = np.cumprod(factors)

    def piece(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words in ``data``, and how many start before each border; no word goes over a border."""
        blank = self.blank[data]
        first, last = ~blank, ~blank
        inner = borders[(borders > 0) & (borders < len(data))]
        first[1:] &= blank[:-1]
        first[inner] = ~blank[inner]
        last[:-1] &= blank[1:]
        last[inner - 1] = ~blank[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.grow(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of_byte[data] * self.powers[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverses[starts]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return np.where(h <= END, h + np.uint64(17), h), np.searchsorted(starts, borders)

    def words(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The hashes of each text's words; a null text has none. Long texts are cut where a word ends."""
        texts = texts.fill_null("").cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        row = 0
        while row < len(texts):
            at = offsets[row]
            end = max(row + 1, int(np.searchsorted(offsets, at + PIECE_BYTES, "right")) - 1)
            if offsets[end] - at <= PIECE_BYTES:
                found, counts = self.piece(data[at : offsets[end]], offsets[row : end + 1] - at)
                yield from np.split(found, counts[1:-1])
            else:
                yield np.concatenate([self.piece(part, np.zeros(0, np.int64))[0] for part in self.cut(data[at : offsets[end]])])
            row = end

    def cut(self, data: np.ndarray) -> Iterator[np.ndarray]:
        at = 0
        while at < len(data):
            end = at + PIECE_BYTES
            while end < len(data):
                step = np.flatnonzero(self.blank[data[end : end + PIECE_BYTES]])
                if len(step):
                    end += int(step[0])
                    break
                end += PIECE_BYTES
            yield data[at:end]
            at = end


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    hashes, block = WordBytes(), Block()
    for b in batches:
        columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("row", "id", "train")]
        words = hashes.words(b.column(b.schema.get_field_index("text")))
        for row, doc_id, train, found in zip(*columns, words, strict=True):
            block.add(row, doc_id, train, found)
            if block.tokens >= BLOCK_TOKENS or len(block.rows) >= 60_000:
                yield block
                block = Block()
    if block.rows:
        yield block


def candidates(rows: DataFrame, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and h and w of pairs, that look hot in one of ``SAMPLED`` texts; and the pairs' keys.

    This only chooses which keys are handled apart: their counts, like all others, are exact
    counts over all texts, and the result is the same whatever is chosen.
    """

    def count(batches):
        for block in blocks(batches):
            h, w, text, train = block.arrays()
            kept = train[text]
            h, w = h[kept], w[kept]
            least = max(2, int(len(w) * share / 2))
            for pair, keys in ((False, w), (True, pair_key(h, w))):
                _, first, times = np.unique(keys, return_index=True, return_counts=True)
                first, times = first[times >= least], times[times >= least]
                yield packed(np.full(len(first), pair), h[first] if pair else np.zeros(len(first), np.uint64), w[first], times)
            yield packed(np.array([False]), np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.array([len(w)]))

    sampled = rows.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLED)) == 0)
    found = stored(sampled.mapInArrow(count, "pair boolean, h long, w long, n long").groupBy("pair", "h", "w").agg(F.sum("n").alias("n")), "frequent")
    tokens = found.where("h = 0 AND w = 0").agg(F.sum("n")).first()[0] or 0
    least = max(HOT_LEAST / SAMPLED, tokens * share)
    often = found.where((F.col("w") != 0) & (F.col("n") >= least)).select("pair", "h", "w").toPandas()
    h, w = (often[c].to_numpy(np.int64).view(np.uint64) for c in ("h", "w"))
    pair = often["pair"].to_numpy(bool)
    words = w[~pair]
    inside = pair.copy()
    inside[pair] = np.isin(w[pair], words)
    return words, h[inside], w[inside]


def packed(pair: np.ndarray, h: np.ndarray, w: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(pair), pa.array(h.view(np.int64)), pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["pair", "h", "w", "n"])


class Hot:
    """Hot words and pairs with their exact counts."""

    def __init__(self, words: np.ndarray, word_counts: np.ndarray, h: np.ndarray, w: np.ndarray, pair_counts: np.ndarray):
        order = np.argsort(words)
        self.words, self.word_counts = words[order], word_counts[order]
        keys = pair_key(h, w)
        order = np.argsort(keys)
        self.pairs, self.h, self.w, self.pair_counts = keys[order], h[order], w[order], pair_counts[order]

    def parts(self) -> tuple:
        return self.words, self.word_counts, self.h, self.w, self.pair_counts

    @staticmethod
    def look(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Counts of the keys wanted, 0 where they aren't hot."""
        if not len(keys):
            return np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, counts[at], 0)


def hot_keys(rows: DataFrame, share: float) -> tuple[Hot, int, int]:
    """Hot words and pairs with exact counts, and the numbers of tokens and texts that train.

    At most 1 / share keys of either kind come to the driver. A key that turns out to occur
    less than HOT_LEAST times is not hot, so that hot counts are above K.
    """
    words, h, w = candidates(rows, share)
    none = np.zeros(0, np.int64)
    hot = Hot(words, np.zeros(len(words), np.int64), h, w, np.zeros(len(h), np.int64))
    plain = rows.sparkSession.sparkContext.broadcast(hot.parts())

    def count(batches):
        keys = Hot(*plain.value)
        for block in blocks(batches):
            h, w, text, train = block.arrays()
            kept = train[text]
            h, w = h[kept], w[kept]
            yield packed(np.array([False, True]), np.ones(2, np.uint64), np.zeros(2, np.uint64), np.array([len(w), train.sum()]))
            for pair, known, seen in ((False, keys.words, w), (True, keys.pairs, pair_key(h, w))):
                if len(known):
                    at = np.minimum(np.searchsorted(known, seen), len(known) - 1)
                    times = np.bincount(at[known[at] == seen], minlength=len(known))
                    here = np.flatnonzero(times)
                    yield packed(np.full(len(here), pair), np.zeros(len(here), np.uint64), known[here], times[here])

    exact = rows.mapInArrow(count, "pair boolean, h long, w long, n long").groupBy("pair", "h", "w").agg(F.sum("n").alias("n")).toPandas()
    total = exact["h"].to_numpy() == 1
    pair, n = exact["pair"].to_numpy(bool), exact["n"].to_numpy(np.int64)
    tokens, texts = (int(n[total & (pair == p)].sum()) for p in (False, True))
    keys = exact["w"].to_numpy(np.int64).view(np.uint64)
    counted = []
    for goal, chosen in ((hot.words, ~pair & ~total), (hot.pairs, pair & ~total)):
        order = np.argsort(keys[chosen])
        counted.append(Hot.look(keys[chosen][order], n[chosen][order], goal))
    kept = counted[0] >= HOT_LEAST
    words, word_counts = hot.words[kept], counted[0][kept]
    kept = (counted[1] >= HOT_LEAST) & np.isin(hot.w, words)
    if not len(words):
        return Hot(words, none, hot.h[:0], hot.w[:0], none), tokens, texts
    return Hot(words, word_counts, hot.h[kept], hot.w[kept], counted[1][kept]), tokens, texts


class Sums:
    """Sums of each text over its tokens, in the columns of TEXT.

    0 tokens, 1 known tokens, 2 log10(c(w) + 0.5), 3 log10 of the counts of seen pairs, and of
    words of unseen pairs (counts above K less TAIL), less log10 c(w) of words that are
    histories, 4 words with c(w) = 0 of unseen pairs, 5 tokens of unseen pairs; then seen pairs
    by count 1..K, and words of unseen pairs by count 1..K.
    """

    @staticmethod
    def of(text: np.ndarray, texts: int, w: np.ndarray, cw: np.ndarray, chw: np.ndarray) -> np.ndarray:
        def add(value):
            return np.bincount(text, value, texts)

        def log(c):
            return np.log10(np.where(c > K, c - TAIL, np.maximum(c, 1)))

        seen, known = chw > 0, cw > 0
        history = known & (w != END)
        out = [
            add(np.ones(len(text))),
            add(known),
            add(np.log10(cw + 0.5)),
            add(np.where(seen, log(chw), np.where(known, log(cw), 0.0)) - np.where(history, np.log10(np.maximum(cw, 1)), 0.0)),
            add(~seen & ~known),
            add(~seen),
        ]
        out += [add(chw == r) for r in range(1, K + 1)]
        out += [add(~seen & (cw == r)) for r in range(1, K + 1)]
        return np.stack(out, axis=1)


REQUEST = "part int, first_row long, n_texts int, train binary, words binary, pairs_of binary, hists binary, texts_of binary, texts binary, ids array<long>"
RESULT_FIELDS = [("kind", pa.string()), ("row", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), *[(c, pa.float64()) for c in TEXT]]
RESULT = ", ".join(["kind string", "row long", "id long", "h long", *[f"{c} double" for c in TEXT]])
RESULT_SCHEMA = pa.schema(RESULT_FIELDS)


def result(kind: str, n: int, columns: dict, sums: np.ndarray) -> pa.RecordBatch:
    """Rows of RESULT; the sums fill the first of the columns d0, d1, ..."""
    out = []
    for name, kind_of in RESULT_FIELDS:
        if name == "kind":
            out.append(pa.array([kind] * n, kind_of))
        elif name in columns:
            out.append(pa.array(columns[name], kind_of))
        elif name[0] == "d" and int(name[1:]) < sums.shape[1]:
            out.append(pa.array(sums[:, int(name[1:])], kind_of))
        else:
            out.append(pa.nulls(n, kind_of))
    return pa.RecordBatch.from_arrays(out, schema=RESULT_SCHEMA)


def pieces(kind: str, columns: dict, sums: np.ndarray, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(sums), size):
        part = sums[at : at + size]
        yield result(kind, len(part), {c: v[at : at + size] for c, v in columns.items()}, part)


def requests(block: Block, hot: Hot, parts: int) -> Iterator[dict]:
    """The block's distinct pairs by part; and, as a negative part, its ids and what hot pairs give its texts.

    The rows of a block follow each other, so the first stands for all.
    """
    h, w, text, train = block.arrays()
    key = pair_key(h, w)
    chw = Hot.look(hot.pairs, hot.pair_counts, key)
    local = chw > 0
    sums = Sums.of(text[local], len(block.rows), w[local], Hot.look(hot.words, hot.word_counts, w[local]), chw[local])
    of_block = {"first_row": block.rows[0], "n_texts": len(block.rows), "train": np.packbits(train).tobytes()}
    yield {"part": -1 - block.rows[0] % parts, **of_block, "words": sums.tobytes(), "ids": block.ids}
    if local.any():
        h, w, text, key = (x[~local] for x in (h, w, text, key))
    spread = Hot.look(hot.words, hot.word_counts, w) > 0
    part = (np.where(spread, key, w * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(parts)
    order = np.lexsort((h, w, part))
    h, w, text, part = (x[order] for x in (h & HISTORY_BITS, w, text, part))
    for p, lo, hi in runs(part):
        hp, wp, tp = h[lo:hi], w[lo:hi], text[lo:hi]
        first = np.flatnonzero(np.concatenate([[True], (hp[1:] != hp[:-1]) | (wp[1:] != wp[:-1])]))
        at = np.flatnonzero(np.concatenate([[True], wp[first][1:] != wp[first][:-1]]))
        yield {
            "part": int(p),
            **of_block,
            "words": wp[first][at].tobytes(),
            "pairs_of": np.diff(np.append(at, len(first))).astype(np.uint32).tobytes(),
            "hists": hp[first].view(np.uint8).reshape(-1, 8)[:, :6].tobytes(),
            "texts_of": np.diff(np.append(first, len(wp))).astype(np.uint32).tobytes(),
            "texts": tp.astype(np.uint16).tobytes(),
        }


def six_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64)[:, 0]


def runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, end) of each run of equal values."""
    edges = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
    for lo, hi in zip(edges, np.append(edges[1:], len(x)), strict=True):
        yield x[lo], int(lo), int(hi)


def answer(batches: Iterator[pa.RecordBatch], hot: Hot) -> Iterator[pa.RecordBatch]:
    """What one part knows: see the module's text."""
    w, h, times, rows, text, trains, known = [], [], [], [], [], [], 0
    for b in batches:
        for q in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
            if q["part"] < 0:
                block = np.arange(q["n_texts"]) + q["first_row"]
                yield result("text", len(block), {"row": block, "id": q["ids"]}, np.frombuffer(q["words"]).reshape(-1, len(TEXT)))
                continue
            w.append(np.repeat(np.frombuffer(q["words"], np.uint64), np.frombuffer(q["pairs_of"], np.uint32)))
            h.append(six_bytes(q["hists"]))
            times.append(np.frombuffer(q["texts_of"], np.uint32))
            here, number = np.unique(np.frombuffer(q["texts"], np.uint16), return_inverse=True)
            rows.append(here + np.int64(q["first_row"]))
            text.append((number + known).astype(np.int32))
            trains.append(np.unpackbits(np.frombuffer(q["train"], np.uint8), count=q["n_texts"]).astype(bool)[here])
            known += len(here)
    if not w:
        return
    w, h, times, rows, text, trains = (np.concatenate(x) for x in (w, h, times, rows, text, trains))
    starts = np.cumsum(times, dtype=np.int64) - times
    sums, counts = np.zeros((len(rows), len(TEXT))), 0.0
    for k in range(SLICES):
        pairs = np.flatnonzero((w >> np.uint64(3)) % np.uint64(SLICES) == k)
        if len(pairs):
            n = times[pairs].astype(np.int64)
            tokens = np.repeat(starts[pairs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own, (keys, by_history), (asked, hists, n), found = answer_slice(w[pairs], h[pairs], n, text[tokens], trains, hot)
            sums += own
            counts = counts + found
            yield from pieces("history", {"h": keys.view(np.int64)}, by_history)
            yield from pieces("unseen", {"row": rows[asked], "h": hists.view(np.int64)}, n[:, None].astype(float))
    yield from pieces("text", {"row": rows}, sums)
    yield result("counts", 1, {}, counts[None, :])


def answer_slice(w: np.ndarray, h: np.ndarray, times: np.ndarray, text: np.ndarray, train: np.ndarray, hot: Hot) -> tuple:
    """Of pairs sent (each with ``times`` tokens, whose texts follow each other in ``text``):
    sums by text, sums by history, (text, history, tokens) of pairs training lacks, and counts of counts."""
    ends = np.cumsum(times)
    learnt = np.concatenate([[0], np.cumsum(train[text])])
    learnt = learnt[ends] - learnt[ends - times]
    # equal pairs of different blocks together
    order = np.lexsort((h, w))
    hs, ws = h[order], w[order]
    new_word = np.concatenate([[True], ws[1:] != ws[:-1]])
    new = new_word | np.concatenate([[True], hs[1:] != hs[:-1]])
    pair_at, word_at = np.cumsum(new) - 1, np.cumsum(new_word) - 1
    chw = np.bincount(pair_at, learnt[order]).astype(np.int64)
    in_part = np.bincount(word_at, learnt[order]).astype(np.int64)
    distinct = np.flatnonzero(new)
    hw, ww, word_of = hs[distinct], ws[distinct], word_at[distinct]
    hot_count = Hot.look(hot.words, hot.word_counts, ws[np.flatnonzero(new_word)])
    cw = np.where(hot_count > 0, hot_count, in_part)[word_of]
    pair_of = np.empty(len(order), np.int64)
    pair_of[order] = pair_at
    token_pair = np.repeat(pair_of, times)
    sums = Sums.of(text, len(train), ww[token_pair], cw[token_pair], chw[token_pair])
    seen = chw > 0
    unseen = np.flatnonzero(~seen[token_pair])
    asked, n = np.unique(np.stack([text[unseen].astype(np.int64), token_pair[unseen]]), axis=1, return_counts=True) if len(unseen) else (np.zeros((2, 0), np.int64), np.zeros(0, int))
    own = in_part[hot_count == 0]
    counts = np.array([(own > 0).sum(), 0, *[(own == r).sum() for r in range(1, K + 2)], *[(chw == r).sum() for r in range(1, K + 2)]], float)
    return sums, histories(hw[seen], chw[seen], cw[seen]), (asked[0], hw[asked[1]], n), counts


def histories(h: np.ndarray, chw: np.ndarray, cw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each h: pairs above K, pairs of count 1..K, sum of c(w) above K, words of count 1..K, words above K."""
    keys, at = np.unique(h, return_inverse=True)
    n = len(keys)
    sums = [np.bincount(at, chw > K, n), *[np.bincount(at, chw == r, n) for r in range(1, K + 1)]]
    sums += [np.bincount(at, np.where(cw > K, cw, 0), n), *[np.bincount(at, cw == r, n) for r in range(1, K + 1)], np.bincount(at, cw > K, n)]
    return keys, np.stack(sums, axis=1)


def discounts(n: list[float]) -> list[float]:
    """d(r) of r = 1..K from the counts of counts n(1)..n(K + 1); absolute discounts where Good-Turing's aren't sound."""
    if n[0] and all(n):
        top = (K + 1) * n[K] / n[0]
        d = [((r + 1) * n[r] / (r * n[r - 1]) - top) / (1 - top) if top < 1 else 0.0 for r in range(1, K + 1)]
        if all(0 < x < 1 for x in d):
            return d
    off = min(0.9, max(TAIL, n[0] / max(1.0, n[0] + 2 * n[1])))
    return [(r - off) / r for r in range(1, K + 1)]


def katz_scores(docs: DataFrame, train, doc_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row; rows with ``train`` are learnt from."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("id"), train.alias("train"), F.col(text).alias("text"))
    hot, tokens, texts = hot_keys(rows, share)
    shared = spark.sparkContext.broadcast(hot.parts())
    all_tokens = tokens * FOLDS // (FOLDS - 1)
    parts = max(8, all_tokens // PART_TOKENS)

    def ask(batches):
        keys = Hot(*shared.value)
        names = [c.split()[0] for c in REQUEST.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.list_(pa.int64())]
        for block in blocks(batches):
            for r in requests(block, keys, parts):
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n)], k) for n, k in zip(names, kinds, strict=True)], names=names)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from answer(batches, Hot(*shared.value))

    asked = rows.mapInArrow(ask, REQUEST)
    found = kept_apart(asked.groupBy("part").applyInArrow(answered, RESULT), "katz")
    count = [f"d{k}" for k in range(2 + 2 * (K + 1))]
    total = found.where("kind = 'counts'").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in count]).first()
    vocabulary = total["d0"] + len(hot.words)
    d1, d2 = (discounts([total[f"d{k}"] for k in range(at, at + K + 1)]) for at in (2, 3 + K))
    n1 = [total[f"d{k}"] for k in range(2, 2 + K)]
    # the mass that all words leave to the class of unknown words
    above = vocabulary - sum(n1)
    unknown = (sum(r * n * (1 - d) for r, n, d in zip(range(1, K + 1), n1, d1, strict=True)) + TAIL * above) / tokens if tokens else 1.0
    # back-off weights
    history = found.where("kind = 'history'").select("h", *TEXT[: 2 * K + 3])
    if len(hot.pairs):
        by_hot = pd.DataFrame({"h": (hot.h & HISTORY_BITS).view(np.int64), "d0": 1.0, f"d{K + 1}": Hot.look(hot.words, hot.word_counts, hot.w).astype(float), f"d{2 * K + 2}": 1.0})
        extra = spark.createDataFrame(by_hot).select("h", *[F.col(c) if c in by_hot else F.lit(0.0).alias(c) for c in TEXT[: 2 * K + 3]])
        history = history.unionAll(extra)
    weights = history.groupBy("h").agg(*[F.sum(c).alias(c) for c in TEXT[: 2 * K + 3]])
    left = TAIL * F.col("d0") + sum(F.col(f"d{r}") * (r * (1 - d2[r - 1])) for r in range(1, K + 1))
    covered = (F.col(f"d{K + 1}") - TAIL * F.col(f"d{2 * K + 2}") + sum(F.col(f"d{K + 1 + r}") * (r * d1[r - 1]) for r in range(1, K + 1))) / max(1, tokens)
    weights = weights.select("h", F.log10(left / (1 - covered)).alias("weight"))
    unseen = found.where("kind = 'unseen'").select("row", "h", F.col("d0").alias("n")).join(weights, "h")
    backed = unseen.groupBy("row").agg(F.sum(F.col("n") * F.col("weight")).alias("backed"))
    sums = found.where("kind = 'text'").groupBy("row").agg(F.max("id").alias("id"), *[F.sum(c).alias(c) for c in TEXT])
    log = [float(np.log10(r * d)) for r, d in zip(range(1, K + 1), d2, strict=True)]
    log1 = [float(np.log10(r * d)) for r, d in zip(range(1, K + 1), d1, strict=True)]
    # d3 has log10 r of pairs and words of count r <= K already
    score = F.col("d3") - (float(np.log10(texts)) if texts else 0.0)
    score += sum(F.col(f"d{5 + r}") * (log[r - 1] - float(np.log10(r))) for r in range(1, K + 1))
    score += sum(F.col(f"d{5 + K + r}") * (log1[r - 1] - float(np.log10(r))) for r in range(1, K + 1))
    score += F.col("d4") * float(np.log10(unknown)) - (F.col("d5") - F.col("d4")) * (float(np.log10(tokens)) if tokens else 0.0)
    base = F.col("d2") - F.col("d0") * float(np.log10(tokens + 0.5 * (vocabulary + 1)))
    return sums.join(backed, "row", "left").select(
        F.col("id").alias(doc_id),
        F.col("d0").cast("long").alias("n_tokens"),
        F.col("d1").cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (score + F.coalesce("backed", F.lit(0.0))).alias("score"),
    )


def kept_apart(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored below the shared folder, partitioned by kind, and read again."""
    from ..conf import shared_dir

    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    # the pairs' shuffle is the largest of all: its files go as soon as the table is written;
    # a task writes the few kinds side by side instead of sorting its rows by kind
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = katz_scores(docs, fold("doc_id", FOLDS) != HELD_OUT)
    held_out = (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op9_katz": (op9_katz, None)}
