"""Word hashes made from arrays of bytes tell words apart as the words themselves do."""

import random

import pyarrow as pa
import pytest

from feedwatch.llm import katz
from feedwatch.llm.common import WORD


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_words_of_bytes_are_the_words(monkeypatch, piece):
    monkeypatch.setattr(katz, "PIECE_BYTES", piece)
    rng = random.Random(piece)
    texts = ["".join(rng.choices("abAB é漢\t\n\x0b\x1f", k=rng.randrange(30))) for _ in range(400)]
    texts += [None, "", " ", "x" * 200, "a b " * 100, None, " lead", "trail ", "É é"]
    column = pa.array([None, "cut", *texts, "off"])[2:-1]
    seen = {}
    found = list(katz.WordBytes().words(column))
    assert len(found) == len(texts)
    for text, hashes in zip(texts, found, strict=True):
        words = WORD.findall((text or "").encode().lower().decode())
        assert len(words) == len(hashes)
        for word, h in zip(words, hashes.tolist(), strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen) > 300


def test_no_texts():
    assert list(katz.WordBytes().words(pa.array([], pa.string()))) == []
    assert [len(x) for x in katz.WordBytes().words(pa.array([None, None], pa.string()))] == [0, 0]
