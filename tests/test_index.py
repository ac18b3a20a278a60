"""The block index: pruned search against scoring everything, batches and deletions against a rebuilt index, pools as masks."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import lexical

WORDS = [f"w{i}" for i in range(40)]


def plain_search(docs, queries, k, allowed=None):
    """BM25 by definition, over lists of words."""
    texts = {d: t.split() for d, t in docs}
    avgdl = sum(map(len, texts.values())) / len(texts)
    df = Counter(w for t in texts.values() for w in set(t))
    raw = {w: math.log(len(texts) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    out = set()
    for q, text in queries:
        scores = {}
        for d, words in texts.items():
            if set(words) & set(text.split()) and (allowed is None or (q, d) in allowed):
                tf = Counter(words)
                scores[d] = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(words) / avgdl)) for w in text.split() if w in tf)
        for rank, d in enumerate(sorted(scores, key=lambda d: (-round(scores[d], 8), d))[:k], 1):
            if scores[d] > 0:
                out.add((q, d, rank, round(scores[d], 6)))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    docs = [(i, " ".join(rng.choices(WORDS, weights=[1 / (j + 1) for j in range(40)], k=rng.choice([0, 3, 8, 8, 30])))) for i in range(n)]
    docs += [(n + i, "w1 w2 w3") for i in range(30)] + [(n + 40, " ".join(["rare"] * 3))]  # ties, and a term of one document
    queries = [(q, " ".join(rng.choices([*WORDS, "rare", "none"], k=rng.randrange(1, 9)))) for q in range(25)] + [(90, "w1 w2 w3"), (91, "w1 w1 w2"), (92, "none")]
    return docs, queries


def frames(spark, docs, queries):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "qid long, text string")


def found(hits):
    return {(r.qid, r.doc_id, r.rank, round(r.score, 6)) for r in hits.collect()}


@pytest.mark.parametrize("k, probed", [(10, 1), (3, 2), (100, 8)])
def test_pruned_search_is_exact(spark, monkeypatch, k, probed):
    monkeypatch.setattr(lexical, "BLOCK_BITS", 2)
    monkeypatch.setattr(lexical, "SPREADS", 2)
    docs, queries = corpus(k, 300)
    d, q = frames(spark, docs, queries)
    index = lexical.write_index(d)
    search = lexical.pruned_search(q, index, k, probed=probed)
    assert found(search.hits.where("score > 0")) == plain_search(docs, queries, k)
    read, blocks = search.read.count(), search.blocks.count()
    assert read == search.read.distinct().count()
    if k == 3:
        assert read < 0.8 * blocks  # the rest was skipped


def test_pools_as_pairs_and_masks(spark):
    docs, queries = corpus(1, 200)
    d, q = frames(spark, docs, queries)
    rng = random.Random(2)
    allowed = {(a, b) for a, _ in queries for b, _ in docs if rng.random() < 0.1 and a != 3}
    pairs = spark.createDataFrame(sorted(allowed), "qid long, doc_id long")
    index = lexical.write_index(d)
    assert found(lexical.bm25_search(q, index, 5, pairs)) == plain_search(docs, queries, 5, allowed)
    pool = lexical.pool_of_pairs(index, pairs, q.where("qid < 10"))
    allowed |= {(a, b) for a, _ in queries if a >= 10 for b, _ in docs}
    assert found(lexical.bm25_search(q, index, 5, lexical.Pool(pool.masks.where("qid < 10"), pool.restricted))) == plain_search(docs, queries, 5, allowed)


def test_batches_give_a_rebuilt_index(spark, tmp_path):
    docs, queries = corpus(5, 120)
    d, q = frames(spark, docs, queries)
    index = lexical.write_index(d, str(tmp_path / "index"))
    new = [(3, "w5 w6 w7"), (500, "w1 fresh"), (501, "")]
    index = lexical.add_documents(index, spark.createDataFrame(new, "doc_id long, text string"))
    live = {**dict(docs), **dict(new)}
    assert found(lexical.bm25_search(q, index, 10)) == plain_search(live.items(), queries, 10)
    before = sorted(p.name for p in (tmp_path / "index").glob("blocks/*/*"))
    index = lexical.remove_documents(index, spark.createDataFrame([(160,), (500,), (7,)], "doc_id long"))
    assert sorted(p.name for p in (tmp_path / "index").glob("blocks/*/*")) == before  # only marks
    live = {i: t for i, t in live.items() if i not in (160, 500, 7)}
    assert found(lexical.bm25_search(q, index, 10)) == plain_search(live.items(), queries, 10)
    again = lexical.read_index(spark, str(tmp_path / "index"))
    assert {tuple(r) for r in again.weights.collect()} == {tuple(r) for r in index.weights.collect()}
    rebuilt = lexical.write_index(spark.createDataFrame(list(live.items()), "doc_id long, text string"))
    close = lambda i: {(r.term, r.df, round(r.idf, 9)) for r in i.weights.collect()}
    assert close(again) == close(rebuilt)
    assert {tuple(r) for r in again.postings.collect()} == {tuple(r) for r in rebuilt.postings.collect()}
    assert again.docs.where(F.col("doc_id") == 3).count() == 2  # the replaced row is marked, not rewritten


def shuffled_records(spark) -> int:
    """Records that all stages of the application have shuffled so far."""
    return sum(s.shuffleWriteRecords() for s in stages_of(spark))


def stages_of(spark) -> list:
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return [stages.apply(i) for i in range(stages.size())]


def test_an_index_shuffles_documents_and_not_postings(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BITS", 2)
    docs, _ = corpus(4, 2000)
    d, _ = frames(spark, docs, [(1, "w1")])
    before = shuffled_records(spark)
    index = lexical.write_index(d)
    shuffled = shuffled_records(spark) - before
    assert index.blocks.count() > 2 * len(docs)
    assert shuffled < 3 * len(docs)  # once by this test, once to its block, and each task's terms with their counts
    assert {(r.doc_id, r.dl) for r in index.docs.collect()} == {(i, len(t.split())) for i, t in docs}


def test_terms_travel_as_text(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BITS", 2)
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(400)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()
    docs.count()
    before = sum(s.shuffleWriteBytes() for s in stages_of(spark))
    lexical._write_segment(docs, lexical.scratch_path(spark, "index"), 0, "doc_id", "text", lexical.tokens)
    shuffled = sum(s.shuffleWriteBytes() for s in stages_of(spark)) - before
    assert shuffled < 0.9 * sum(map(len, texts))


def test_terms_of_any_bytes_come_back(spark):
    texts = ["é 漢字 😀 a", "", None, " a  b", "漢 字 漢字", "x" * 300 + " é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    index = lexical.write_index(docs, tokenizer=lambda c: F.split(c, " "))
    plain = {(i, w, n) for i, t in enumerate(texts) if t is not None for w, n in Counter(t.split(" ")).items()}
    assert {(r.doc_id, r.term, r.tf) for r in index.postings.collect()} == plain


def test_forms_of_queries_are_one_search(spark, monkeypatch):
    docs, queries = corpus(5, 200)
    d, q = frames(spark, docs, queries)
    other = q.where("qid % 2 = 0").select("qid", F.concat(F.lit("w3 "), "text").alias("text"))
    index = lexical.write_index(d)
    apart = {name: found(lexical.bm25_search(form, index, 5)) for name, form in {"one": q, "other": other}.items()}
    searches, search = [], lexical.pruned_search
    monkeypatch.setattr(lexical, "pruned_search", lambda *a, **o: searches.append(1) or search(*a, **o))
    both = lexical.bm25_searches({"one": q, "other": other}, index, 5)
    assert {name: found(hits) for name, hits in both.items()} == apart
    assert len(searches) == 1 and apart["one"] != apart["other"]


def test_two_runs_are_searched_at_once(spark, monkeypatch):
    from quarry.queries import load

    sf, searches, search = "/root/testdata/sf0.001", [], lexical.pruned_search
    monkeypatch.setattr(lexical, "pruned_search", lambda *a, **o: searches.append(1) or search(*a, **o))
    for name in ("report_table", "best_run"):
        searches.clear()
        load()[0][name](spark, sf).collect()
        assert len(searches) == 1, name
