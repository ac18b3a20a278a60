"""Measures of toxicity against a plain version, and texts taken in pieces against the same texts whole."""

import math
import random
import re

import numpy as np
import pytest

from quarry.llm import toxicity, words
from quarry.llm.toxicity import ORDER, RunTable, distinct_words, evidence, run_counts


def runs_of(word: str) -> list[int]:
    padded = b"\0" * (ORDER - 1) + word.encode() + b"\1"
    return [int.from_bytes(padded[i : i + ORDER], "big") for i in range(len(padded) - ORDER + 1)]


def plain_evidence(text, ratio):
    found = [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower()) if w]
    if not found:
        return [0.0] * 8
    sums = [(sum(ratio.get(r, ratio.get(r >> 8 << 8, 0.0)) for r in runs_of(w)), len(w.encode()) + 1) for w in found]
    top = sorted((s for s, _ in sums), reverse=True)
    top = (top + [top[-1]] * 3)[:3]
    many = [math.log1p(sum(s > least for s, _ in sums)) for least in (3, 6)]
    raw = [sum(s for s, _ in sums) / sum(n for _, n in sums), *top, max(s / n for s, n in sums), *many, math.log1p(len(sums))]
    return [max(-20.0, min(20.0, x)) for x in raw]


@pytest.fixture(scope="module")
def material():
    chance = random.Random(12)
    word = lambda: "".join(chance.choice("abcdé0ΣI") for _ in range(chance.randint(1, 9)))
    text = lambda n: "".join(word() + chance.choice([" ", "\n", "'", "--", ". "]) for _ in range(n))
    texts = [None, "", " .\n", "a", "ab cd", "ab ab ab ab", *(text(chance.randint(1, 60)) for _ in range(60)), text(3_000), "ab" * 5_000, text(2_000)]
    seen = {r for t in texts[:40] for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower()) if w for r in runs_of(w)}
    ratio = {r: float(np.float32(chance.uniform(-3, 4))) for r in sorted(seen) if chance.random() < 0.8}
    ratio |= {r >> 8 << 8: float(np.float32(chance.uniform(-1, 1))) for r in sorted(seen)}
    return texts, ratio, RunTable(np.array(list(ratio), dtype=np.uint64), np.array(list(ratio.values()), dtype=np.float32))


def small_pieces(monkeypatch):
    monkeypatch.setattr(words, "PIECE", 50)
    monkeypatch.setattr(toxicity, "PIECE", 50)


@pytest.mark.parametrize("cut", [False, True])
def test_evidence_equals_a_plain_version(material, monkeypatch, cut):
    texts, ratio, table = material
    if cut:
        small_pieces(monkeypatch)
        assert len(toxicity.long_texts(texts)) > 5
    assert np.allclose(evidence(texts, table), [plain_evidence(t, ratio) for t in texts], atol=1e-4)


def test_words_of_cut_texts(material, monkeypatch):
    whole = distinct_words(material[0])
    small_pieces(monkeypatch)
    assert all(np.array_equal(a, b) for a, b in zip(whole, distinct_words(material[0]), strict=True))


def test_counts_of_a_very_long_text(spark):
    """A text of several pieces counts each run once, as its words in short texts would, and other texts count as before."""
    chance = random.Random(1)
    some = ["".join(chance.choice("abc") for _ in range(5)) for _ in range(40)]
    long = " ".join(chance.choice(some) for _ in range(900_000))
    assert len(long) > 4 * words.PIECE
    rows = spark.createDataFrame([(long, True), ("abc", False), (None, True)], "text string, is_toxic boolean").coalesce(1)
    got = {r.run: (r.toxic, r.ordinary) for r in run_counts(rows, "text").collect()}
    want: dict[int, list[int]] = {}
    for text, at in ((" ".join(some), 0), ("abc", 1)):
        for r in {r for w in text.split() for r in runs_of(w)}:
            want.setdefault(r, [0, 0])[at] += 1
    assert got == {r: tuple(n) for r, n in want.items()}


def test_memory_follows_the_piece(material):
    """A text of 40 MB is measured with some times a piece's bytes, not its own."""
    import tracemalloc

    text = "ab cdab é0 " * 3_700_000
    tracemalloc.start()
    evidence([text], material[2])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * len(text.encode()), peak
