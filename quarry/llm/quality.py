"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; unlabelled are web documents as
they come, whatever their labels.  A linear model on measures of the text minimises
the non-negative unbiased risk

    prior E_P[l(g)] + max(0, E_U[l(-g)] - prior E_P[l(-g)]),   l(g) = log(1 + exp(-g)),

with the class prior estimated as the share of good ones among all labelled training rows.
Where the second part is negative, a step ascends it, which keeps the model from
treating every unlabelled document as bad.  The logistic loss makes sigmoid(g)
an estimate of the probability of being good.

Measures are made for a batch of texts at once, over whole texts.  The model is fitted on
bounded samples (parameters ``positives`` and ``unlabelled``); scoring is one pass without a shuffle.

Defined cases: null, empty and blank texts score 0 (nothing to learn from).  Without positives,
or without unlabelled rows, every other text scores 0.5.  Labels may repeat or be null; null
labels are not used.  Rows without doc_id are scored like others and train nothing.
Repeated rows, of documents or labels, train once and are scored as often as they come.  Texts of
any length are measured a piece at a time.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried
from .labelled import by_hash, fold
from .words import PIECE, WordTable, pieces, text_slices

POSITIVES, UNLABELLED = 4000, 8000
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
_SHAPES = 10


def _counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of each text, what adds up over its pieces: characters by value and sums over words; its words' hashes without repeats; and those of its first and last word."""
    table = WordTable(texts, "space")
    n = len(texts)
    raw, sizes = table.raw, table.text_size
    owner = np.repeat(np.arange(n), sizes + 1)
    histogram = np.bincount(owner * 128 + np.minimum(raw, 127), minlength=n * 128).reshape(n, 128).astype(np.float64)
    histogram[:, 32] -= 1  # the blank after each text
    words = np.diff(table.bounds)
    word_owner = np.repeat(np.arange(n), words)
    hashes, lengths = table.hashes, table.end - table.start
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (word_owner[1:] == word_owner[:-1])
    first, last = raw[table.start] if len(hashes) else raw[:0], raw[table.end - 1] if len(hashes) else raw[:0]
    letters = (first >= 97) & (first <= 122) | (first >= 65) & (first <= 90) | (first > 127)
    flags = [again, ~letters, np.isin(last, np.frombuffer(b"!*%&$#|", np.uint8)), (first >= 65) & (first <= 90), lengths == 1]
    sums = np.column_stack([words, np.bincount(word_owner, lengths, n), *(np.bincount(word_owner[f], minlength=n) for f in flags)]).astype(np.float64)
    spans = list(zip(table.bounds[:-1].tolist(), table.bounds[1:].tolist(), strict=True))
    ends = np.array([(hashes[a], hashes[b - 1]) if b > a else (0, 0) for a, b in spans], dtype=np.uint64).reshape(n, 2)
    return histogram, sums, [np.unique(hashes[a:b]) for a, b in spans], ends


def _long_counts(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """The same of one text, piece by piece; only its distinct words are held together."""
    histogram, sums, seen, before = np.zeros((1, 128)), np.zeros((1, 7)), np.zeros(0, np.uint64), None
    for piece in pieces(text, "space"):
        h, s, distinct, ends = _counts([piece])
        histogram, sums, seen = histogram + h, sums + s, np.union1d(seen, distinct[0])
        if s[0, 0]:
            sums[0, 2] += before is not None and before == ends[0, 0]  # a repetition across the cut
            before = ends[0, 1]
    return histogram, sums, len(seen)


def measures(texts: list[str | None]) -> np.ndarray:
    """A row of measures for each text: shares of the ASCII characters, and shapes of words and lines.

    A text of several pieces (``words.PIECE`` characters, cut between words) is measured piece by piece.
    """
    long = [i for i, t in enumerate(texts) if t is not None and len(t) > 4 * PIECE]
    histogram, sums, hashes, _ = _counts([None if i in long else t for i, t in enumerate(texts)] if long else texts)
    distinct = np.array([len(h) for h in hashes], dtype=np.float64)
    for i in long:
        histogram[i : i + 1], sums[i : i + 1], distinct[i] = _long_counts(texts[i])
    words, lengths, again, strange, marks, capitals, singles = sums.T
    per_word = np.maximum(words, 1)
    out = np.empty((len(texts), 128 + _SHAPES))
    out[:, :128] = np.sqrt(histogram / np.maximum(histogram.sum(axis=1), 1)[:, None])
    shapes = [
        again / per_word,
        distinct / per_word,
        np.log(distinct + 1) - 0.7 * np.log(words + 1),
        np.log1p(words),
        np.log1p(lengths / per_word),
        strange / per_word,
        marks / per_word,
        capitals / per_word,
        singles / per_word,
        np.log1p(histogram[:, 10] / per_word * 10),
    ]
    out[:, 128:] = np.column_stack(shapes)
    return out


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, ridge: float = 1e-4) -> np.ndarray:
    """Weights (the last is the intercept) that minimise the non-negative unbiased risk, by Adam on full batches."""
    p, u = (np.column_stack((x, np.ones(len(x)))) for x in (positive, unlabelled))
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        gp, gu = np.clip(p @ w, -30, 30), np.clip(u @ w, -30, 30)
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        good = prior * p.T @ (sp - 1) / len(p)
        bad = u.T @ su / len(u) - prior * p.T @ sp / len(p)
        gradient = good + bad + ridge * w if rest >= 0 else -bad
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _matrix(docs: DataFrame, text: str) -> np.ndarray:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([row.astype("<f4").tobytes() for row in measures(texts)], pa.binary())], names=["row"])

    one_each = docs.where(F.trim(F.col(text)) != "").groupBy("doc_id").agg(F.min(text).alias(text)).select(text)  # as many rows as ids, however often they are repeated
    rows = one_each.mapInArrow(measure, "row binary").collect()  # bounded by the samples
    return np.array([np.frombuffer(r.row, "<f4") for r in sorted(rows)], dtype=np.float64).reshape(len(rows), 128 + _SHAPES)


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED):
    """The model: means, scales and weights, or None where there is nothing to learn from."""
    known = labels.select("doc_id", "quality").where("quality is not null").where(fold(FOLDS) != HELD_OUT).distinct()
    share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    good = by_hash(known.where("quality = 1").select("doc_id").distinct(), positives, 1)
    web = by_hash(docs.select("doc_id").where(fold(FOLDS) != HELD_OUT).distinct(), unlabelled, 2)
    marked = good.withColumn("is_good", F.lit(True)).join(web.withColumn("is_web", F.lit(True)), "doc_id", "full")
    sample = docs.select("doc_id", text).join(F.broadcast(marked), "doc_id")  # ids of the samples: bounded
    p, u = _matrix(sample.where("is_good"), text), _matrix(sample.where("is_web"), text)
    if not len(p) or not len(u):
        return None
    both = np.vstack((p, u))
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    prior = min(max(share, 0.05), 0.98)
    return mean, scale, fit_pu(np.clip((p - mean) / scale, -6, 6), np.clip((u - mean) / scale, -6, 6), prior)


def scores_of(texts: list[str | None], model) -> np.ndarray:
    values = np.full(len(texts), 0.5)
    if model is not None:
        mean, scale, w = model
        x = np.clip((measures(texts) - mean) / scale, -6, 6)
        values = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
    values[[not (t or "").strip() for t in texts]] = 0.0
    return values


def score_quality(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """doc_id and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores_of(texts, shared.value))], names=["doc_id", "score"])

    return docs.select("doc_id", text).mapInArrow(score, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score (likelihood of being good), predicted."""
    scored = score_quality(docs, fit_quality(docs, labels, text), text)
    return scored.select("doc_id", F.coalesce(fold(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_rejected(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the classifier doesn't reject, with all their columns; each is judged by its own text, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, text))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                good = pa.array(scores_of(texts, shared.value) >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).filter(good)], names=["whole"])

    rows = carried(docs, [F.col(text)])
    return rows.mapInArrow(keep, rows.select("whole").schema).select("whole.*")
