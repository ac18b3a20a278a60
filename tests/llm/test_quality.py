"""The quality classifier: repeated rows, long texts, and the risk against a plain version."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import quality, words

SF = "/root/testdata/sf0.01"


def held_out_right(scores, labels):
    return [(r.score >= 0.7) == bool(labels[r.doc_id]) for r in scores if r.held_out and r.doc_id in labels]


def test_a_repeated_row_changes_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    once = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    least = docs.where(quality.fold(4) != 2).orderBy(F.xxhash64("doc_id", F.lit(2))).limit(1)
    many = docs.unionByName(least.crossJoin(spark.range(9000)).drop("id"))
    many_labels = labels.unionByName(labels.where("quality = 0").limit(1).crossJoin(spark.range(5000)).drop("id"))
    scored = quality.quality_scores(many, many_labels).collect()
    assert {r.doc_id: round(r.score, 6) for r in scored} == {k: round(v, 6) for k, v in once.items()}
    right = held_out_right({r.doc_id: r for r in scored}.values(), known)
    assert all(right) and len(right) > 50


def test_folds(spark):
    rows = spark.range(50).withColumnRenamed("id", "doc_id")
    assert {r.doc_id for r in rows.where(quality.fold(4) == 2).collect()} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["one", "one", "Two", "!!", "x", "drei\n", "é%"]) for _ in range(rng.randrange(300))) for _ in range(40)] + ["", None, "w" * 500, "same same " * 60]
    whole = quality.measures(texts)
    monkeypatch.setattr(quality, "PIECE", 8)
    monkeypatch.setattr(words, "PIECE", 8)
    assert np.allclose(quality.measures(texts), whole)


def plain_risk(w, p, u, prior):
    loss = lambda g: math.log(1 + math.exp(-g))
    g = lambda x: sum(a * b for a, b in zip(w, [*x, 1.0], strict=True))
    positive = prior * sum(loss(g(x)) for x in p) / len(p)
    rest = sum(loss(-g(x)) for x in u) / len(u) - prior * sum(loss(-g(x)) for x in p) / len(p)
    return positive + max(0.0, rest)


def test_fit_minimises_the_non_negative_risk():
    rng = np.random.default_rng(4)
    good, bad = rng.normal(1.5, 1, (150, 2)), rng.normal(-1.5, 1, (150, 2))
    p, u = good[:80], np.vstack((good[80:140], bad[:90]))
    prior = 0.4
    w = quality.fit_pu(p, u, prior)
    best = plain_risk(w, p.tolist(), u.tolist(), prior)
    for _ in range(60):  # no worse than anything near it, or than nothing learnt
        assert best <= plain_risk(w + rng.normal(0, 0.3, 3), p.tolist(), u.tolist(), prior) + 0.02
    assert best < plain_risk([0, 0, math.log(prior / (1 - prior))], p.tolist(), u.tolist(), prior) - 0.1
    side = lambda x: (x @ w[:2] + w[2] > 0).mean()
    assert side(good[140:]) > 0.8 and side(bad[90:]) < 0.2
