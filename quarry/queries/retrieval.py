"""Lexical and dense search, fusion, re-ranking and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import dense, lexical, metrics, rank, vector_blocks
from ..session import stored
from ..sizes import small
from . import query, table

K = 20


def items(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def long_words(queries: DataFrame) -> DataFrame:
    """A second form of each query: its tokens of five letters or more."""
    return queries.select("qid", F.array_join(F.filter(tokens(F.col("text")), lambda t: F.length(t) >= 5), " ").alias("text"))


_indexes: dict[tuple[str, str, str], lexical.Index] = {}


def index_of(spark, d, tokenizer: lexical.Tokenizer = tokens) -> lexical.Index:
    """The index of the documents; the first query of an application that asks for it writes it."""
    key = (spark.sparkContext.applicationId, d, tokenizer.__name__)
    if key not in _indexes:
        _indexes[key] = lexical.write_index(table(spark, d, "documents"), tokenizer=tokenizer)
    return _indexes[key]


_golds: dict[tuple[str, str], DataFrame] = {}


def gold(spark, d) -> DataFrame:
    """qid, doc_id: the documents whose text contains the item; the first query of an application that asks for them writes them.

    A document that contains an item holds its inner tokens, so its rarest inner token finds the candidates in the index,
    and only their texts are compared.  Items without inner tokens are compared with all texts.
    """
    key = (spark.sparkContext.applicationId, d)
    if key not in _golds:
        _golds[key] = stored(_contained(spark, d), "gold")
    return _golds[key]


def _contained(spark, d) -> DataFrame:
    index, docs = index_of(spark, d), table(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    words = items(spark, d).withColumn("words", tokens(F.col("text")))
    inner = words.where("size(words) > 2").select("qid", "text", F.explode(F.expr("slice(words, 2, size(words) - 2)")).alias("term"))
    known = index.weights.join(small(inner.select("term").distinct()), "term").select("term", "df")
    rarest = inner.join(small(known), "term", "left").groupBy("qid", "text").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "term"))["term"].alias("term"))
    rarest = stored(rarest, "rarest")
    candidates = stored(index.postings_of(rarest).join(small(rarest.select("qid", "term")), "term").select("qid", "doc_id"), "candidates")
    # ids go to the texts, so that texts stay where they are
    found = docs.join(small(candidates), "doc_id").join(small(rarest.select("qid", "text")), "qid").where(F.contains("body", "text")).select("qid", "doc_id")
    short = small(words.where("size(words) <= 2").select("qid", "text"))
    return found.unionByName(docs.join(short, F.contains("body", "text")).select("qid", "doc_id"))


def leg(spark, d, form=None, k: int = K) -> DataFrame:
    queries = items(spark, d)
    return lexical.bm25_search(form(queries) if form else queries, index_of(spark, d), k)


def both_legs(spark, d, k: int = K) -> dict[str, DataFrame]:
    """The hits of the items and of their long words, searched as one batch: a block's postings are sent once for both."""
    queries = items(spark, d)
    return lexical.bm25_searches({"full": queries, "long": long_words(queries)}, index_of(spark, d), k)


def rounded(df: DataFrame, *columns: str, places: int = 5) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# ---- SQL building blocks ---------------------------------------------------------------------------------------

_BASE = r"""
WITH RECURSIVE q1 AS (SELECT item_id AS qid, text FROM benchmark),
q2 AS (SELECT qid, array_to_string(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda t: length(t) >= 5), ' ') AS text FROM q1),
dt AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS term FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
len AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
gold AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
"""


def _leg(name: str, source: str, k: int = K, allowed: str = "") -> str:
    return rf""",
{name}_t AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS term FROM {source}) GROUP BY ALL),
{name}_s AS (SELECT qid, p.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM {name}_t JOIN idf USING (term) JOIN post p USING (term) JOIN len USING (doc_id), st {allowed} GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, doc_id) AS rank FROM {name}_s) WHERE rank <= {k} AND score > 0)
"""


LEGS = _BASE + _leg("l1", "q1") + _leg("l2", "q2")


def _metrics_sql(hits: str, cuts: str = "(5), (10), (20)") -> str:
    return f""",
g AS (SELECT qid, count(*) AS n_gold FROM (SELECT DISTINCT qid, doc_id FROM gold) GROUP BY qid),
{hits}_f AS (SELECT qid, list(rank ORDER BY rank) AS ranks FROM {hits} SEMI JOIN gold USING (qid, doc_id) GROUP BY qid),
{hits}_p AS (SELECT q.qid, k, coalesce(n_gold, 0) AS n_gold, list_filter(coalesce(ranks, []), lambda r: r <= k) AS rs
  FROM (SELECT DISTINCT qid FROM q1) q CROSS JOIN (VALUES {cuts}) c(k) LEFT JOIN g USING (qid) LEFT JOIN {hits}_f USING (qid)),
{hits}_m AS (SELECT qid, k, n_gold, CASE WHEN n_gold = 0 THEN 0.0 ELSE len(rs) / n_gold END AS recall, CASE WHEN len(rs) > 0 THEN 1.0 ELSE 0.0 END AS hit,
  coalesce(1.0 / rs[1], 0.0) AS mrr,
  CASE WHEN n_gold = 0 THEN 0.0 ELSE coalesce(list_sum([1 / log2(r + 1) for r in rs]), 0.0) / list_sum([1 / log2(i + 1) for i in range(1, least(n_gold, k) + 1)]) END AS ndcg FROM {hits}_p)
"""


# ---- search ----------------------------------------------------------------------------------------------------


@query("bm25_postings", _BASE + "SELECT * FROM post")
def bm25_postings(spark, d):
    return lexical.postings(table(spark, d, "documents")).drop("dl")


@query("bm25_corpus_stats", _BASE + "SELECT n AS n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM idf) AS n_terms, round((SELECT avg(idf) FROM idf), 6) AS mean_idf FROM st")
def bm25_corpus_stats(spark, d):
    index = index_of(spark, d)
    weights = index.weights.agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.avg("idf"), 6).alias("mean_idf"))
    return index.stats.select("n_docs", F.round("avgdl", 6).alias("avgdl")).crossJoin(F.broadcast(weights))


@query("bm25_term_weights", _BASE + "SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_term_weights(spark, d):
    return rounded(index_of(spark, d).weights, "idf", places=6)


@query("bm25_topk", _BASE + _leg("l1", "q1", 10) + "SELECT qid, doc_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM l1")
def bm25_topk(spark, d):
    return rounded(leg(spark, d, k=10), "score")


_DENSE = """
WITH q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT qid, vec_id AS doc_id, list_dot_product(v, CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings {0}),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, doc_id) AS rank FROM s) WHERE rank <= 10)
"""


def _vectors(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return vectors.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid"), vectors


@query("dense_topk", _DENSE.format("") + "SELECT qid, doc_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM h")
def dense_topk(spark, d):
    return rounded(dense.dense_search(*_vectors(spark, d)), "score")


@query("dense_blocks_topk", _DENSE.format("WHERE qid <> vec_id") + "SELECT qid, doc_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM h")
def dense_blocks_topk(spark, d):
    """The neighbours of the same vectors from stored blocks, which a search reads only where their bounds are good enough."""
    queries, vectors = _vectors(spark, d)
    return rounded(vector_blocks.search_blocks(queries, vector_blocks.write_blocks(vectors), exclude_self=True).hits, "score")


@query("dense_exclude_self", _DENSE.format("WHERE qid <> vec_id") + "SELECT qid, doc_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM h")
def dense_exclude_self(spark, d):
    return rounded(dense.dense_search(*_vectors(spark, d), exclude_self=True), "score")


@query(
    "dense_label_precision",
    _DENSE.format("WHERE qid <> vec_id") + "SELECT a.label, count(*) AS n, round(avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END), 6) AS precision FROM h JOIN embeddings a ON a.vec_id = qid JOIN embeddings b ON b.vec_id = doc_id GROUP BY a.label",
)
def dense_label_precision(spark, d):
    hits = dense.dense_search(*_vectors(spark, d), exclude_self=True)
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    both = hits.join(labels.withColumnRenamed("vec_id", "qid"), "qid").join(labels.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("found")), "doc_id")
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("found")).cast("double")), 6).alias("precision"))


# ---- fusion ----------------------------------------------------------------------------------------------------

_FUSED = """,
fs AS (SELECT qid, doc_id, sum(w / (60 + rank)) AS score FROM (SELECT *, {0} AS w FROM l1 UNION ALL SELECT *, {1} AS w FROM l2) GROUP BY ALL),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, doc_id) AS rank FROM fs) WHERE rank <= 20)
"""


@query("rrf_fuse", LEGS + _FUSED.format("1.0", "1.0") + "SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM fused")
def rrf_fuse(spark, d):
    return rounded(rank.rrf(rank.union_runs(both_legs(spark, d))), "score", places=6)


@query("rrf_weighted", LEGS + _FUSED.format("2.0", "0.5") + "SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM fused")
def rrf_weighted(spark, d):
    weights = spark.createDataFrame([("full", 2.0), ("long", 0.5)], "run string, weight double")
    return rounded(rank.rrf(rank.union_runs(both_legs(spark, d)), weights=weights), "score", places=6)


_SWEEP = """,
w AS (SELECT * FROM (VALUES (0.5, 1.0), (1.0, 1.0), (1.5, 1.0), (2.0, 1.0), (3.0, 1.0), (5.0, 1.0), (1.0, 1.5), (1.0, 2.0), (1.0, 3.0)) t(w_full, w_long)),
fs AS (SELECT w_full, w_long, qid, doc_id, sum(CASE WHEN leg = 1 THEN w_full ELSE w_long END / (60 + rank)) AS score FROM (SELECT 1 AS leg, * FROM l1 UNION ALL SELECT 2, * FROM l2), w GROUP BY ALL),
fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w_full, w_long, qid ORDER BY round(score, 8) DESC, doc_id) AS rank FROM fs) WHERE rank <= 50),
fg AS (SELECT w_full, w_long, qid, min(rank) AS best FROM fr SEMI JOIN gold USING (qid, doc_id) GROUP BY ALL)
SELECT w_full, w_long, k, round(count(*) FILTER (WHERE best <= k) / (SELECT count(*) FROM q1), 6) AS recall
FROM w CROSS JOIN (VALUES (10), (20), (50)) c(k) LEFT JOIN fg USING (w_full, w_long) GROUP BY ALL"""


@query("rrf_weight_sweep", _BASE + _leg("l1", "q1", 50) + _leg("l2", "q2", 50) + _SWEEP)
def rrf_weight_sweep(spark, d):
    return sweep(spark, d, both_legs(spark, d, 50))


def sweep(spark, d, runs: dict[str, DataFrame]) -> DataFrame:
    """The recall of two runs fused with several weights, as one plan."""
    one, other = (f"w_{name}" for name in runs)
    pairs = [(a, 1.0) for a in (0.5, 1.0, 1.5, 2.0, 3.0, 5.0)] + [(1.0, b) for b in (1.5, 2.0, 3.0)]
    settings = spark.createDataFrame(pairs, f"{one} double, {other} double")
    names = [F.lit(name) for name in runs]
    weights = settings.select(one, other, F.explode(F.create_map(names[0], one, names[1], other)).alias("run", "weight"))
    fused = rank.rrf(rank.union_runs(runs), 50, weights=weights, by=(one, other, "qid"))
    best = fused.join(gold(spark, d), ["qid", "doc_id"]).groupBy(one, other, "qid").agg(F.min("rank").alias("best"))
    n = items(spark, d).agg(F.count(F.lit(1)).alias("n"))
    grid = settings.crossJoin(F.broadcast(spark.createDataFrame([(10,), (20,), (50,)], "k int"))).join(best, [one, other], "left")
    found = grid.groupBy(one, other, "k").agg(F.count(F.when(F.col("best") <= F.col("k"), 1)).alias("found"))
    return found.crossJoin(F.broadcast(n)).select(one, other, "k", F.round(F.col("found") / F.col("n"), 6).alias("recall"))


@query(
    "hybrid_lexical_dense",
    _BASE + _leg("l1", "q1") + """,
dq AS (SELECT qid, min(doc_id) AS anchor FROM l1 JOIN embeddings ON vec_id = doc_id WHERE rank <= 10 GROUP BY qid),
ds AS (SELECT qid, e.vec_id AS doc_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM dq JOIN embeddings a ON a.vec_id = anchor, embeddings e),
l2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, doc_id) AS rank FROM ds) WHERE rank <= 20)
""" + _FUSED.format("1.0", "1.0") + "SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM fused",
)
def hybrid_lexical_dense(spark, d):
    """Lexical hits fused with the neighbours of the smallest of the ten best hits that has a vector."""
    hits = leg(spark, d)
    _, vectors = _vectors(spark, d)
    anchors = hits.where("rank <= 10").join(vectors.select("doc_id"), "doc_id", "left_semi").groupBy("qid").agg(F.min("doc_id").alias("doc_id"))
    queries = anchors.join(vectors, "doc_id").select("qid", "vector")
    return rounded(rank.rrf(rank.union_runs({"lexical": hits, "dense": dense.dense_search(queries, vectors, 20)})), "score", places=6)


@query(
    "multi_query_fusion",
    LEGS + _leg("l3", "q3").replace(",\nl3_t", ",\nq3 AS (SELECT qid, array_to_string(list_reverse(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))[1:8], ' ') AS text FROM q1),\nl3_t", 1) + """,
fs AS (SELECT qid, doc_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) GROUP BY ALL)
SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, doc_id) AS rank FROM fs) WHERE rank <= 20""",
)
def multi_query_fusion(spark, d):
    """Rewrites fan out to several queries, whose runs are fused."""
    tail = lambda q: q.select("qid", F.array_join(F.slice(F.reverse(tokens(F.col("text"))), 1, 8), " ").alias("text"))
    return rounded(rank.rrf(rank.union_runs({**both_legs(spark, d), "tail": leg(spark, d, tail)})), "score", places=6)


@query(
    "config_legs",
    LEGS + _FUSED.format("1.0", "1.0") + _metrics_sql("l1", "(10)") + _metrics_sql("fused", "(10)").replace(",\ng AS (SELECT qid, count(*) AS n_gold FROM (SELECT DISTINCT qid, doc_id FROM gold) GROUP BY qid),", ",", 1)
    + "SELECT 'lexical' AS config, count(*) AS n, round(avg(hit), 6) AS hit, round(avg(mrr), 6) AS mrr FROM l1_m UNION ALL SELECT 'rrf', count(*), round(avg(hit), 6), round(avg(mrr), 6) FROM fused_m",
)
def config_legs(spark, d):
    """Two configurations of the same pipeline, evaluated: one leg as it is, or both fused."""
    from ..plans.search import SearchPlan

    docs, queries, qrels = table(spark, d, "documents"), items(spark, d), gold(spark, d)
    index = index_of(spark, d)
    out = None
    for name, plan in {"lexical": SearchPlan(index), "rrf": SearchPlan(index, forms={"full": None, "long": long_words})}.items():
        per = metrics.per_query(queries, plan.run(queries, docs), qrels, (10,))
        part = metrics.macro(per).select(F.lit(name).alias("config"), "n", F.round("hit", 6).alias("hit"), F.round("mrr", 6).alias("mrr"))
        out = part if out is None else out.unionByName(part)
    return out


_RERANK = r""",
rp AS (SELECT qid, doc_id, rank AS before, list_distinct(regexp_extract_all(q1.text, '[\p{L}\p{N}_]+')) AS w, list_distinct(regexp_extract_all(d.text, '[\p{L}\p{N}_]+')) AS t
  FROM l1 JOIN q1 USING (qid) JOIN documents d USING (doc_id)),
rs AS (SELECT qid, doc_id, before, coalesce(len(list_intersect(w, t)) / nullif(len(w), 0), 0.0) AS score FROM rp),
rr AS (SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, before) AS rank FROM rs) WHERE rank <= 10)
"""


@query("rerank_lexical_standin", _BASE + _leg("l1", "q1") + _RERANK + "SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rr")
def rerank_lexical_standin(spark, d):
    return rounded(rank.rerank(leg(spark, d), items(spark, d), table(spark, d, "documents"), 10), "score", places=6)


# ---- metrics ---------------------------------------------------------------------------------------------------

_ONE = _BASE + _leg("l1", "q1") + _metrics_sql("l1")


def _per_query(spark, d):
    return metrics.per_query(items(spark, d), leg(spark, d), gold(spark, d))


def _per_query_of_both(spark, d) -> dict[str, DataFrame]:
    return {name: metrics.per_query(items(spark, d), hits, gold(spark, d)) for name, hits in both_legs(spark, d).items()}


@query("containment_gold", _BASE + "SELECT qid, doc_id FROM gold")
def containment_gold(spark, d):
    return gold(spark, d)


@query("ir_metrics_by_k", _ONE + "SELECT k, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM l1_m GROUP BY k")
def ir_metrics_by_k(spark, d):
    return rounded(metrics.macro(_per_query(spark, d)), "recall", "hit", "mrr", "ndcg", places=6)


for _name in ("recall", "hit", "mrr", "ndcg"):

    @query(f"{_name}_at_k", _ONE + f"SELECT qid, k, n_gold, round({_name}, 6) AS {_name} FROM l1_m")
    def _metric(spark, d, name=_name):
        return _per_query(spark, d).select("qid", "k", "n_gold", F.round(name, 6).alias(name))


@query(
    "gold_rank_overlap",
    LEGS + """,
r AS (SELECT qid, (SELECT min(rank) FROM l1 SEMI JOIN (SELECT * FROM gold g2 WHERE g2.qid = b.qid) g3 USING (qid, doc_id)) AS a,
  (SELECT min(rank) FROM l2 SEMI JOIN (SELECT * FROM gold g2 WHERE g2.qid = b.qid) g3 USING (qid, doc_id)) AS b FROM (SELECT DISTINCT qid FROM gold) b)
SELECT k, count(*) AS n, count(*) FILTER (WHERE a <= k AND b <= k) AS n_both, count(*) FILTER (WHERE a <= k AND (b > k OR b IS NULL)) AS n_first, count(*) FILTER (WHERE b <= k AND (a > k OR a IS NULL)) AS n_second,
  count(*) FILTER (WHERE a <= k OR b <= k) AS n_union FROM r CROSS JOIN (VALUES (5), (10), (20)) c(k) GROUP BY k""",
)
def gold_rank_overlap(spark, d):
    ranks = rank.gold_ranks(gold(spark, d), both_legs(spark, d)).withColumn("k", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20))))
    a, b = F.coalesce(F.col("rank_full") <= F.col("k"), F.lit(False)), F.coalesce(F.col("rank_long") <= F.col("k"), F.lit(False))
    return ranks.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(a & b).alias("n_both"), F.count_if(a & ~b).alias("n_first"), F.count_if(b & ~a).alias("n_second"), F.count_if(a | b).alias("n_union"))


_TWO = LEGS + _metrics_sql("l1", "(10)") + _metrics_sql("l2", "(10)").replace(",\ng AS (SELECT qid, count(*) AS n_gold FROM (SELECT DISTINCT qid, doc_id FROM gold) GROUP BY qid),", ",", 1)


@query(
    "run_compare_slices",
    _TWO + "SELECT CASE WHEN length(text) > 120 THEN 'long' ELSE 'short' END AS slice, count(*) AS n, round(avg(a.hit), 6) AS a, round(avg(b.hit), 6) AS b, round((avg(b.hit) - avg(a.hit)) * 100, 6) AS points FROM l1_m a JOIN l2_m b USING (qid) JOIN q1 USING (qid) GROUP BY GROUPING SETS ((), (slice))",
)
def run_compare_slices(spark, d):
    slices = items(spark, d).select("qid", F.when(F.length("text") > 120, "long").otherwise("short").alias("slice"))
    return rounded(metrics.compare_runs(*_per_query_of_both(spark, d).values(), slices), "a", "b", "points", places=6)


@query("rescued_broken", _TWO + "SELECT qid, CASE WHEN b.hit > a.hit THEN 'rescued' ELSE 'broken' END AS change FROM l1_m a JOIN l2_m b USING (qid) WHERE a.hit <> b.hit")
def rescued_broken(spark, d):
    full, long = _per_query_of_both(spark, d).values()
    a = full.where("k = 10").select("qid", F.col("hit").alias("a"))
    b = long.where("k = 10").select("qid", F.col("hit").alias("b"))
    return a.join(b, "qid").where("a <> b").select("qid", F.when(F.col("b") > F.col("a"), "rescued").otherwise("broken").alias("change"))


@query("miss_inspection", _BASE + _leg("l1", "q1", 10) + "SELECT qid, text, (SELECT count(*) FROM gold g WHERE g.qid = q1.qid) AS n_gold FROM q1 WHERE qid NOT IN (SELECT qid FROM l1 SEMI JOIN gold USING (qid, doc_id))")
def miss_inspection(spark, d):
    qrels = gold(spark, d)
    found = leg(spark, d, k=10).join(qrels, ["qid", "doc_id"], "left_semi").select("qid")
    n = qrels.groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"))
    return items(spark, d).join(found, "qid", "left_anti").join(n, "qid", "left").fillna({"n_gold": 0})


@query("best_run", _TWO + "SELECT run, hit FROM (SELECT 1 AS o, 'full' AS run, round(avg(hit), 6) AS hit FROM l1_m UNION ALL SELECT 2, 'long', round(avg(hit), 6) FROM l2_m) ORDER BY hit DESC, o LIMIT 1")
def best_run(spark, d):
    """The best run; of equal ones, the first."""
    runs = _per_query_of_both(spark, d)
    parts = [metrics.macro(per).where("k = 10").select(F.lit(i).alias("o"), F.lit(name).alias("run"), F.round("hit", 6).alias("hit")) for i, (name, per) in enumerate(runs.items())]
    best = parts[0].unionByName(parts[1]).agg(F.max_by(F.struct("run", "hit"), F.struct("hit", -F.col("o"))).alias("best"))
    return best.select("best.run", "best.hit")


@query("embedding_cache_join", "SELECT vec_id, substr(sha256('model' || chr(1) || CAST(vec_id AS VARCHAR)), 1, 16) AS key, vec_id % 2 = 0 AS cached FROM embeddings")
def embedding_cache_join(spark, d):
    """Which rows an embedding cache holds, by content key: the cache here holds every second row."""
    from ..functions.text import row_key

    rows = table(spark, d, "embeddings").select("vec_id", row_key(F.lit("model"), F.col("vec_id").cast("string")).alias("key"))
    cache = rows.where("vec_id % 2 = 0").select("key", F.lit(True).alias("cached"))
    return rows.join(cache, "key", "left").fillna({"cached": False})


@query("rewrite_cache_join", "SELECT item_id AS qid, substr(sha256('multi|m1|' || text), 1, 16) AS key, CASE WHEN item_id % 3 = 0 THEN reverse(text) ELSE text END AS rewritten FROM benchmark")
def rewrite_cache_join(spark, d):
    """Cached rewrites by content key, and the query itself where none is cached."""
    from ..functions.text import cache_key

    rows = items(spark, d).withColumn("key", cache_key(F.lit("multi"), F.lit("m1"), F.col("text")))
    cache = rows.where("qid % 3 = 0").select("key", F.reverse("text").alias("cached")).dropDuplicates(["key"])
    return rows.join(cache, "key", "left").select("qid", "key", F.coalesce("cached", "text").alias("rewritten"))
