"""Scores of (query, text) pairs by a model in Python, in batches of like lengths."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

Scorer = Callable[[list[tuple[str, str]]], Sequence[float]]


def token_count(query: Column, text: Column) -> Column:
    return F.size(tokens(query)) + F.size(tokens(text))


@dataclass(frozen=True)
class PairModel:
    """``load`` makes a scorer of a list of (query, text); a worker calls it once and keeps the scorer under ``name``.

    A batch has at most ``most`` pairs, and its longest pair times their number, which is what padding makes of it, is at most ``budget``
    in the unit of ``size``.  A pair longer than the budget is a batch alone: texts are never cut here.
    """

    name: str
    load: Callable[[], Scorer]
    budget: int = 65_536
    most: int = 512
    size: Callable[[Column, Column], Column] = token_count


#: The scorer that this worker holds, by name: one at a time, since models are large.
_held: dict[str, Any] = {}


def held(model_name: str, load: Callable[[], Scorer]) -> Scorer:
    if model_name not in _held:
        _held.clear()
        _held[model_name] = load()
    return _held[model_name]


def batch_ends(sizes: Iterable[int], budget: int, most: int) -> Iterator[int]:
    """Where batches end in a list of sizes that falls: the first size of a batch is its longest."""
    begin, longest, i = 0, 0, 0
    for i, size in enumerate(sizes):
        if i == begin:
            longest = size
        elif i - begin == most or longest * (i - begin + 1) > budget:
            yield i
            begin, longest = i, size
        i += 1
    if i > begin:
        yield i


def score_pairs(pairs: DataFrame, model: PairModel, *keys: str) -> DataFrame:
    """keys, score: the model's score of every row's ``query`` and ``text``; null counts as empty, repeated rows are scored each.

    Rows are dealt by a hash of their keys, so a long document that many queries hit is spread, and sorted by falling length
    inside a task, so that a batch has little padding and the longest pairs come first.  Further columns of ``pairs`` are left out.
    """
    name, load, budget, most = model.name, model.load, model.budget, model.most
    rows = pairs.select(*keys, *(F.coalesce(c, F.lit("")).alias(c) for c in ("query", "text")))
    rows = rows.withColumn("size", model.size(F.col("query"), F.col("text"))).repartition(*keys).sortWithinPartitions(F.desc("size"), *keys)

    def score(frames):
        scorer = None
        for frame in frames:
            scorer = scorer or held(name, load)
            found, begin = [], 0
            for end in batch_ends(frame["size"], budget, most):
                batch = list(zip(frame["query"][begin:end], frame["text"][begin:end], strict=True))
                scores = list(scorer(batch))
                if len(scores) != len(batch):
                    raise ValueError(f"model {name}: {len(scores)} scores for {len(batch)} pairs")
                found += map(float, scores)
                begin = end
            yield frame[list(keys)].assign(score=found)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.mapInPandas(score, f"{schema}, score double")
