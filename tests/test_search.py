"""Dense search with pools and blocks, tables kept by key, running numbers, and NFKC, against plain versions."""

import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import dense, evalsets, rewrites
from quarry.sources import tables


@pytest.mark.parametrize("blocks", [(8192, 20_000), (3, 7)])
@pytest.mark.parametrize("pool", [False, True])
@pytest.mark.parametrize("exclude", [False, True])
def test_dense_search(spark, monkeypatch, blocks, pool, exclude):
    for name in ("QUERY_BLOCK", "POOL_QUERY_BLOCK"):
        monkeypatch.setattr(dense, name, blocks[0])
    for name in ("DOC_BLOCK", "POOL_DOC_BLOCK"):
        monkeypatch.setattr(dense, name, blocks[1])
    monkeypatch.setattr(dense, "STEP", 4)
    rng = np.random.default_rng(5)
    vectors = rng.integers(-3, 4, (40, 5)).astype(float)  # small integers: many ties
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "doc_id long, vector array<double>").repartition(3)
    queries = docs.where("doc_id % 4 = 0").withColumnRenamed("doc_id", "qid")
    allowed = {(q, d) for q in range(0, 40, 4) for d in range(40) if rng.random() < 0.3 and q != 8} | {(0, 999), (777, 1)}
    table = spark.createDataFrame(sorted(allowed), "qid long, doc_id long") if pool else None
    got = sorted((r.qid, r.rank, r.doc_id, r.score) for r in dense.dense_search(queries, docs, 6, exclude, table).collect())
    want = []
    for q in range(0, 40, 4):
        score = vectors @ vectors[q]
        ids = [d for d in range(40) if not (exclude and d == q) and (not pool or (q, d) in allowed)]
        for rank, d in enumerate(sorted(ids, key=lambda d: (-score[d], d))[:6], 1):
            want.append((q, rank, d, score[d]))
    assert got == sorted(want)


def test_upsert_and_insert_with_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "key int, value string, at int")
    new = spark.createDataFrame([(2, "x", 5), (2, "y", 4), (3, "p", 1), (3, "q", 1)], "key int, value string, at int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(tables.latest_by_key(old, new, "key", order=F.col("at"))) == [(1, "a", 0), (2, "x", 5), (3, "q", 1)]
    assert rows(tables.latest_by_key(old, new, "key")) == [(1, "a", 0), (2, "y", 4), (3, "q", 1)]
    assert rows(tables.insert_absent(old, new, "key")) == [(1, "a", 0), (2, "b", 0), (3, "q", 1)]


def test_numbers_run_over_all_ranges(spark):
    rows = spark.range(100).select((F.col("id") * 7 % 100).alias("id"), F.lit("x").alias("range_name")).repartition(7)
    assert sorted((r.number, r.id) for r in evalsets.numbered(rows, "id").collect()) == [(i, i) for i in range(100)]
    assert evalsets.numbered(rows.where("false"), "id").count() == 0


def test_nfkc(spark):
    texts = ["ﬁne ①②", "Ｆｕｌｌ　ｗｉｄｔｈ", "é", "é", "ｶﾞ", "", None, "㍿ x²"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(T.nfkc("t")).collect()]
    assert got == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def test_tokenizers(spark):
    row = spark.createDataFrame([("資料 科學AI", None, "a", "")], "a string, b string, c string, d string")
    got = row.select(*(T.character_bigrams(F.col(c)) for c in "abcd"), *(T.mixed_tokens(F.col(c)) for c in "abcd")).first()
    assert list(got) == [["資料", "料科", "科學", "學A", "AI"], [], ["a"], [], ["資料", "科學", "學A", "AI"], [], ["a"], []]


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="unknown mode"):
        rewrites.fan_out(spark.createDataFrame([(1, "x")], "qid long, text string"), spark.createDataFrame([], "key string, texts array<string>"), "other")


def test_texts_stay_where_they_are(spark):
    """Gold and re-ranking send ids to the documents; texts are not dealt out."""
    from quarry.operators import rank
    from quarry.queries import retrieval as R

    d = "/root/testdata/sf0.001"
    index = R.index_of(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    hits = index.docs.selectExpr("doc_id % 40 as qid", "doc_id", "1.0 as score", "1 as rank")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # or the fixture's tables would be small by themselves
    try:
        for found in (R._contained(spark, d), rank.rerank(hits, R.items(spark, d), docs, 10).where("rank > 0")):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning(doc_id" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
