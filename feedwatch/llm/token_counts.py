"""Token counts with a whole-token shortcut.

A text is cut into pre-tokens that no merge can cross. Which vocabulary strings
encode alone as one token is proved once, with the library itself, before the job
starts; a pre-token among those counts 1 without any merging. Only the rest goes
through the library's merges, each distinct pre-token of a batch once.

``proof`` checks the two facts the cut rests on, and falls back to whole texts when a
vocabulary doesn't have them:

* no piece has the white-space mark after another character, so a merge never crosses
  the start of a run of blanks;
* no piece but the byte pieces holds a line feed, so a line feed is always one token
  of its own and stops every merge.

Nulls and empty texts have 0 tokens; a text is always counted whole.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, table

SPACE = "▁"
#: Blanks then other characters, a run of blanks alone, or one line feed.
PRETOKEN = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
LIMIT = 4096
#: Distinct pre-tokens remembered by a Python worker before it starts afresh.
REMEMBERED = 200_000

ADDED = T.StructType([T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens", "n_merged")])


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def proof(model) -> frozenset[str] | None:
    """The vocabulary strings that encode alone as one token; None if cuts are not safe.

    A line feed put in front stands for "no blank before", and its two tokens (the
    blank every text starts with, and its byte) are taken off again.
    """
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    plain = [
        (i, p)
        for i, p in enumerate(pieces)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for _, p in plain):
        return None
    head = model.encode("\n")
    if len(head) != 2 or not model.is_byte(head[1]) or model.normalize("a  b\n ") != f"{SPACE}a{SPACE}{SPACE}b\n{SPACE}":
        return None
    encoded = model.encode(["\n" + p for _, p in plain], num_threads=1)
    return frozenset(p for (i, p), ids in zip(plain, encoded, strict=True) if ids == [*head, i])


class Counts:
    """Counts the tokens of texts; one for each Python worker's task."""

    def __init__(self, path: str, whole: frozenset[str] | None):
        self.model, self.whole, self.known = load(path), whole, {}

    def batch(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, tokens that came from merges) of each text."""
        if self.whole is None:
            return [(n, n) for n in map(len, self.model.encode(texts, num_threads=1))]
        found = [Counter(PRETOKEN.findall(SPACE + t.replace(" ", SPACE))) if t else Counter() for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        whole, known = self.whole, self.known
        rest = list({p for c in found for p in c if p not in whole and p not in known and p != "\n"})
        if rest:
            encoded = self.model.encode(["\n" + p for p in rest], num_threads=1)
            known.update(zip(rest, (len(ids) - 2 for ids in encoded), strict=True))
        out = []
        for c in found:
            direct = merged = 0
            for p, times in c.items():
                if p in whole or p == "\n":
                    direct += times
                else:
                    merged += times * known[p]
            out.append((direct + merged, merged))
        return out


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and n_merged (tokens that needed merges) of every row.

    Other columns are not read. Repeated rows are counted one by one; an empty table
    gives an empty result.
    """
    whole = docs.sparkSession.sparkContext.broadcast(proof(load(path)))

    def start():
        counts = Counts(path, whole.value)

        def count(texts: list[str | None]) -> list[list[int]]:
            texts = [t or "" for t in texts]
            found = counts.batch(texts)
            return [[len(t.encode()) for t in texts], [n for n, _ in found], [m for _, m in found]]

        return count

    return map_texts(docs.select(doc_id, text), ADDED, start, text)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), vocabulary_path())
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op6_token_counts": (op6_token_counts, None)}
