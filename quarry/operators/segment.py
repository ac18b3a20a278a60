"""Word segmentation of unspaced scripts by a dictionary: the most probable path through the graph of its words."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

HAN = r"\p{IsHan}"
#: A dictionary goes to every worker; larger ones raise an error.
MOST_WORDS = 2_000_000
#: Costs are whole numbers, so that sums and ties are the same everywhere.
SCALE = 1e6


def _word_costs(words: DataFrame) -> tuple[dict[str, int], int]:
    counts = words.where("word <> '' and count > 0").groupBy("word").agg(F.sum("count").alias("count"))
    rows = counts.limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a dictionary of more than {MOST_WORDS} words")
    total = math.log(max(1, sum(r["count"] for r in rows)))
    return {r["word"]: round(SCALE * (total - math.log(r["count"]))) for r in rows}, round(SCALE * (total + math.log(2)))


def best_path(text: str, costs: dict[str, int], lengths: dict[str, tuple[int, ...]], alone: int) -> list[str]:
    """The words of the cheapest path, from the end to the start; of equal paths the one whose first word is longer, and so on."""
    n = len(text)
    total, step = [0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        best = None
        for length in lengths.get(text[i], ()):  # longest first
            cost = costs.get(text[i : i + length]) if i + length <= n else None
            if cost is not None and (best is None or cost + total[i + length] < best):
                best, step[i] = cost + total[i + length], length
        if text[i] not in costs and (best is None or alone + total[i + 1] < best):
            best, step[i] = alone + total[i + 1], 1
        total[i] = best
    out, i = [], 0
    while i < n:
        out.append(text[i : i + step[i]])
        i += step[i]
    return out


def segmenter(words: DataFrame, script: str = HAN) -> Callable[[Column], Column]:
    """A tokenizer from a dictionary ``words`` (word, count): tokens that hold ``script`` are cut into words, all others stay whole.

    A word costs the logarithm of total / count.  A character that is no word stands alone at the cost of half an occurrence,
    so unknown words come out in single characters, and index and queries agree on them; nothing is guessed.
    Null and empty texts give no tokens.  Time and memory grow with the text's length, whatever its runs.
    """
    costs, alone = _word_costs(words)
    found: dict[str, set[int]] = {}
    for word in costs:
        found.setdefault(word[0], set()).add(len(word))
    lengths = {first: tuple(sorted(some, reverse=True)) for first, some in found.items()}
    shared = words.sparkSession.sparkContext.broadcast((costs, lengths, alone))

    def words_of(found) -> list[str]:
        costs, lengths, alone = shared.value
        return [w for t in found for w in (best_path(t["token"], costs, lengths, alone) if t["unspaced"] else (t["token"],))]

    @F.pandas_udf("array<string>")
    def cut(found: pd.Series) -> pd.Series:
        return found.map(words_of)

    def segmented(text: Column) -> Column:
        # texts go to Python as their tokens, marked where they hold the script
        return cut(F.transform(tokens(text), lambda t: F.struct(t.alias("token"), t.rlike(script).alias("unspaced"))))

    return segmented
