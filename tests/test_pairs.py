"""Batch scoring of pairs: equal to the column scorer, within the budget, one load a worker, long documents spread."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators.pairs import PairModel, batch_ends, score_pairs
from quarry.operators.rank import overlap_score, rerank
from quarry.queries.plans import overlap_model


def test_batches_cover_all_and_keep_the_budget():
    chance = random.Random(3)
    for _ in range(300):
        sizes = sorted((chance.choice([0, 1, 5, 40, 900]) for _ in range(chance.randint(0, 60))), reverse=True)
        budget, most = chance.choice([1, 50, 1000]), chance.randint(1, 9)
        ends = list(batch_ends(sizes, budget, most))
        assert ends == sorted(set(ends)) and (ends[-1:] or [0]) == [len(sizes)]
        for begin, end in zip([0, *ends], ends):
            assert 0 < end - begin <= most and (end - begin == 1 or sizes[begin] * (end - begin) <= budget)


@pytest.fixture(scope="module")
def catalog(spark):
    chance = random.Random(5)
    text = lambda n: " ".join(chance.choice("ab cd ef gh ü 漢字 x_1".split()) for _ in range(n))
    docs = [(i, text(chance.randint(0, 40))) for i in range(50)] + [(50, None), (51, ""), (52, text(30_000))]
    queries = [(i, text(chance.randint(1, 4))) for i in range(8)] + [(8, None), (9, "")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("query", F.lit("clash")).withColumn("score", F.lit(9.0))
    queries = spark.createDataFrame(queries, "qid long, text string")
    hits = queries.crossJoin(docs).select("qid", "doc_id", F.lit(0.0).alias("score"), (F.col("doc_id") + 1).cast("int").alias("rank"))
    return hits, queries, docs


@pytest.mark.parametrize("normalise", [False, True])
def test_equals_the_column_scorer(catalog, normalise):
    got, want = (sorted(map(tuple, rerank(*catalog, 7, s, normalise).collect())) for s in (overlap_model(), overlap_score))
    assert got == want and len(got) == 70


def test_loads_once_a_worker_and_sorts_by_length(spark, catalog):
    hits, queries, docs = catalog
    loads, batches, padded = (spark.sparkContext.accumulator(0) for _ in range(3))

    def load():
        loads.add(1)

        def score(pairs):
            batches.add(1)
            longest = max(len((q + " " + t).split()) for q, t in pairs)
            padded.add(longest * len(pairs))
            assert len(pairs) == 1 or longest * len(pairs) <= 200
            return [0.0] * len(pairs)

        return score

    model = PairModel("counted", load, budget=200, most=16)
    pairs = hits.join(queries.withColumnRenamed("text", "query"), "qid").join(docs.select("doc_id", "text"), "doc_id")
    first = score_pairs(pairs, model, "qid", "doc_id").collect()
    assert len(first) == pairs.count() == 530
    after_one = loads.value
    assert 1 <= after_one <= 4  # the workers of local[4]
    score_pairs(pairs, model, "qid", "doc_id").collect()
    assert loads.value <= 4  # a worker that has it doesn't load it again
    tokens = 2 * sum(len(((r.query or "") + " " + (r.text or "")).split()) for r in pairs.collect())
    assert padded.value < 1.2 * tokens


def test_long_documents_are_spread(catalog):
    hits, queries, docs = catalog
    pairs = hits.where("doc_id = 52").join(queries.withColumnRenamed("text", "query"), "qid").join(docs.select("doc_id", "text"), "doc_id")
    model = PairModel("zero", lambda: lambda pairs: [0.0] * len(pairs))
    session = pairs.sparkSession
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = score_pairs(pairs, model, "qid", "doc_id").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        session.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1


def test_empty_tables_and_wrong_models(catalog):
    hits, queries, docs = catalog
    assert rerank(hits.limit(0), queries, docs, 5, overlap_model()).count() == 0
    with pytest.raises(Exception, match="0 scores for"):
        rerank(hits, queries, docs, 5, PairModel("short", lambda: lambda pairs: [])).collect()
