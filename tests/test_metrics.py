import math

import pytest

from quarry.operators import lexical, metrics, rank


def test_metrics_of_small_lists(spark):
    queries = spark.createDataFrame([(1, "q"), (2, "q"), (3, "q")], "qid int, text string")
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 20, 1), (2, 21, 2), (2, 22, 3)], "qid int, doc_id int, rank int")
    gold = spark.createDataFrame([(1, 11), (1, 99), (2, 22)], "qid int, doc_id int")
    got = {(r.qid, r.k): r for r in metrics.per_query(queries, hits, gold, (2, 3)).collect()}
    assert got[1, 3].recall == 0.5 and got[1, 3].mrr == 0.5 and got[1, 3].hit == 1
    assert got[1, 3].ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert got[2, 3].mrr == pytest.approx(1 / 3) and got[2, 2].hit == 0
    assert got[3, 3].recall == 0 and got[3, 3].n_gold == 0
    assert {r.k: r.n for r in metrics.macro(metrics.per_query(queries, hits, gold, (2, 3))).collect()} == {2: 3, 3: 3}


def test_fusion_adds_repeated_documents(spark):
    runs = spark.createDataFrame([("a", 1, 5, 1.0, 1), ("a", 1, 5, 1.0, 2), ("b", 1, 6, 1.0, 1)], "run string, qid int, doc_id int, score double, rank int")
    got = {r.doc_id: r.score for r in rank.rrf(runs).collect()}
    assert got[5] == pytest.approx(1 / 61 + 1 / 62) and got[6] == pytest.approx(1 / 61)


def test_bm25_drops_scores_that_are_not_positive(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "a c"), (4, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "b b"), (2, ""), (3, "zzz")], "qid long, text string")
    hits = lexical.bm25_search(queries, lexical.write_index(docs), 10).collect()
    assert [(h.qid, h.doc_id, h.rank) for h in hits] == [(1, 1, 1)]
