"""Pruned search of stored vector blocks against all products."""

import numpy as np
import pytest

from quarry.operators import vector_blocks as V


def plain(vectors, ids, queries, k, exclude, allowed):
    want = []
    for q, v in queries:
        score = [(-round(float(x @ v), 8), d) for x, d in zip(vectors, ids) if not (exclude and d == q) and (allowed is None or (q, d) in allowed)]
        want += [(q, rank, d, round(-s, 6)) for rank, (s, d) in enumerate(sorted(score)[:k], 1)]
    return sorted(want)


def found(search):
    return sorted((r.qid, r.rank, r.doc_id, round(r.score, 6)) for r in search.hits.collect())


@pytest.mark.parametrize("pool", [False, True])
@pytest.mark.parametrize("exclude", [False, True])
def test_equals_all_products(spark, monkeypatch, pool, exclude):
    for name, value in {"BLOCK": 8, "CHUNK": 5, "HEADERS": 3, "CENTRES": 6}.items():
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(6, 5)) * 4
    vectors = np.round(middles[rng.integers(0, 6, 200)] + rng.normal(size=(200, 5)) * 0.2, 1)
    vectors[120:] = vectors[7]  # a third of the rows and more are equal
    ids = [i % 190 for i in range(200)]  # some ids stand on two rows
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)] + [(None, [0.0] * 5), (999, None)], "doc_id long, vector array<double>").repartition(5)
    asked = [(q, vectors[q]) for q in range(0, 190, 10)]
    queries = spark.createDataFrame([(q, v.tolist()) for q, v in asked] + [(None, [1.0] * 5), (1000, None)], "qid long, vector array<double>")
    allowed = {(q, d) for q, _ in asked for d in range(190) if rng.random() < 0.2 and q != 20} | {(0, 5000), (5000, 1)}
    blocks = V.write_blocks(docs)
    assert blocks.blocks.count() > 20 and blocks.vectors.count() == 200
    search = V.search_blocks(queries, blocks, 6, exclude, spark.createDataFrame(sorted(allowed), "qid long, doc_id long") if pool else None, probed=2)
    assert found(search) == plain(vectors, ids, asked, 6, exclude, allowed if pool else None)
    if not pool:
        assert search.read.count() < 0.8 * len(asked) * blocks.blocks.count()


def test_nothing_stored_and_nothing_asked(spark):
    none = spark.createDataFrame([], "doc_id long, vector array<double>")
    one = spark.createDataFrame([(1, [1.0, 2.0])], "doc_id long, vector array<double>")
    asked = one.withColumnRenamed("doc_id", "qid")
    assert V.search_blocks(asked, V.write_blocks(none)).hits.count() == 0
    assert V.search_blocks(asked.where("false"), V.write_blocks(one)).hits.count() == 0
    assert [tuple(r) for r in V.search_blocks(asked, V.write_blocks(one)).hits.collect()] == [(1, 1, 5.0, 1)]


def test_no_vectors_of_pairs_are_broadcast(spark):
    """The queries' vectors reach the blocks once a chunk; before, once for each block that a query asks for."""
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(600, 3)), 1)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "doc_id long, vector array<double>")
    queries = docs.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "qid")
    search = V.search_blocks(queries, V.write_blocks(docs), 4, probed=1)
    assert found(search) == plain(vectors, range(600), [(q, vectors[q]) for q in range(0, 600, 2)], 4, False, None)
    plan = search.hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" in plan and "Join Inner" not in plan, plan  # no join of pairs (qid, block) with vectors
