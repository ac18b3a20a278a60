"""Searches by configuration: tokenizers, rewrites, hybrid legs, caches and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evalsets, lexical, metrics, rank, rewrites, vector_blocks
from ..operators.pairs import PairModel
from ..operators.segment import segmenter
from ..plans.search import SearchPlan
from ..session import scratch_path, stored
from ..sources.cache import new_cache, through_cache
from . import query, table
from .parsers import dealt, dealt_values, frame
from .retrieval import LEGS, _BASE, _FUSED, _RERANK, _SWEEP, _leg, _metrics_sql, _per_query_of_both, gold, index_of, items, leg, long_words, rounded, sweep

# ---- tokenizers ------------------------------------------------------------------------------------------------

_LETTERS = r"list_filter(string_split(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]+', '', 'g'), ''), lambda c: c <> '')"
_PAIRS = f"(CASE WHEN len({_LETTERS}) < 2 THEN {_LETTERS} ELSE list_transform(list_zip(({_LETTERS})[1:-2], ({_LETTERS})[2:]), lambda z: z[1] || z[2]) END)"


@query("bm25_bigrams_topk", (_BASE + _leg("l1", "q1", 10)).replace(r"regexp_extract_all(text, '[\p{L}\p{N}_]+')", _PAIRS) + "SELECT qid, doc_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM l1")
def bm25_bigrams_topk(spark, d):
    """The same search with another tokenizer, which documents and queries share."""
    return rounded(lexical.bm25_search(items(spark, d), index_of(spark, d, T.character_bigrams), 10), "score")


MIXED = ((1, "機器學習 deep learning", "機器,器學,學習,deep,learning"), (2, "AI課", "AI,I課"), (3, "中 文", "中,文"), (4, "", ""), (5, None, ""), (6, "no_han 12", "no_han,12"))


@query("mixed_tokens", dealt_values([(w,) for _, _, w in MIXED], "words", "c_custkey, CASE WHEN words = '' THEN c_mktsegment ELSE words || ',' || c_mktsegment END AS words"))
def mixed_tokens(spark, d):
    text = F.concat_ws(" ", "text", "c_mktsegment")
    return dealt(spark, d, [(t,) for _, t, _ in MIXED], "text string").select("c_custkey", F.array_join(T.mixed_tokens(text), ",").alias("words"))


@query(
    "segmented_sentences",
    r"""WITH RECURSIVE w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) GROUP BY word),
a AS (SELECT CAST(round(1e6 * (ln(sum(n)) + ln(2))) AS BIGINT) AS alone, max(length(word)) AS longest FROM w),
c AS (SELECT word, CAST(round(1e6 * (ln(sum(n) OVER ()) - ln(n))) AS BIGINT) AS cost FROM w),
u AS (SELECT DISTINCT regexp_replace(x, '[^a-z]', '', 'g') AS text FROM (SELECT unnest(string_split(lower(text), '.')) AS x FROM benchmark)),
p AS (SELECT text, unnest(range(1, length(text) + 1)) AS i FROM u),
h AS (SELECT text, i, l, cost FROM (SELECT text, i, unnest(range(1, least(longest, length(text) - i + 1) + 1)) AS l FROM p, a) JOIN c ON word = substr(text, i, l)
  UNION ALL SELECT text, i, 1, alone FROM p, a WHERE substr(text, i, 1) NOT IN (SELECT word FROM w)),
e AS (SELECT text, i, list({'l': l, 'cost': cost}) AS steps FROM h GROUP BY ALL),
s AS (SELECT text, length(text) AS i, [{'cost': CAST(0 AS BIGINT), 'shorter': CAST(0 AS BIGINT), 'words': CAST([] AS VARCHAR[])}] AS best FROM u WHERE text <> ''
  UNION ALL SELECT s.text, s.i - 1, list_prepend(list_sort(list_transform(steps, lambda z: {'cost': z.cost + best[z.l].cost, 'shorter': -z.l, 'words': list_prepend(substr(s.text, s.i, z.l), best[z.l].words)}))[1], best)[1:(SELECT longest FROM a)]
  FROM s JOIN e ON e.text = s.text AND e.i = s.i)
SELECT text, array_to_string(best[1].words, ' ') AS words, CAST(len(best[1].words) AS INTEGER) AS n FROM s WHERE i = 0""",
)
def segmented_sentences(spark, d):
    """The items' sentences without their blanks, cut into words again by a dictionary that the items make."""
    text = table(spark, d, "benchmark").select(F.lower("text").alias("text"))
    words = text.select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]+)"), F.lit(1))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    runs = text.select(F.explode(F.split("text", "[.]")).alias("text")).select(F.regexp_replace("text", "[^a-z]", "").alias("text")).where("text <> ''").distinct()
    found = runs.select("text", segmenter(words, "[a-z]")(F.col("text")).alias("words"))
    return found.select("text", F.array_join("words", " ").alias("words"), F.size("words").alias("n"))


# ---- rewrites --------------------------------------------------------------------------------------------------


def rewrite_cache(spark, d) -> DataFrame:
    """key, texts: answers for some of the items in each mode."""
    q = items(spark, d)
    answers = {
        "hyde": (F.array(F.reverse("text")), "qid % 3 = 0"),
        "q2d": (F.array(F.when(F.col("qid") % 2 == 0, F.concat(F.lit("about "), "text")).otherwise(F.lit("other words"))), "qid % 3 <> 2"),
        "stepback": (F.array(F.concat(F.lit(" 「"), F.substring("text", 1, 10), F.lit("」"))), "qid % 2 = 0"),
        "multi": (F.array(F.lit(" a "), F.col("text"), F.lit(""), F.reverse("text"), F.lit("x"), F.lit("y"), F.lit("z")), "qid % 2 = 1"),
    }
    out = None
    for mode, (texts, some) in answers.items():
        part = q.where(some).select(T.cache_key(F.lit(mode), F.lit("m1"), F.col("text")).alias("key"), texts.alias("texts"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "rewrite_fan_out",
    r"""WITH q AS (SELECT item_id AS qid, text FROM benchmark),
m AS (SELECT 'raw' AS mode, qid, [text] AS t FROM q
  UNION ALL SELECT 'hyde', qid, [CASE WHEN qid % 3 = 0 THEN reverse(text) ELSE text END] FROM q
  UNION ALL SELECT 'q2d', qid, [CASE WHEN qid % 3 = 2 THEN text WHEN qid % 2 = 0 THEN 'about ' || text ELSE text || '。' || 'other words' END] FROM q
  UNION ALL SELECT 'stepback', qid, CASE WHEN qid % 2 = 0 THEN [text, substr(text, 1, 10)] ELSE [text] END FROM q
  UNION ALL SELECT 'multi', qid, CASE WHEN qid % 2 = 1 THEN [text] || (list_filter(['a', text, '', reverse(text), 'x', 'y', 'z'], lambda v: v <> '' AND v <> text))[1:4] ELSE [text] END FROM q)
SELECT mode, qid, unnest(t) AS text, generate_subscripts(t, 1) - 1 AS number FROM m""",
)
def rewrite_fan_out(spark, d):
    """How many queries each mode searches, with and without a cached answer."""
    cache, out = rewrite_cache(spark, d), None
    for mode in ("raw", "hyde", "q2d", "stepback", "multi"):
        part = rewrites.fan_out(items(spark, d), cache, mode, "m1").select(F.lit(mode).alias("mode"), "qid", "text", F.col("number").cast("long").alias("number"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "fan_out_search",
    LEGS.replace("FROM q2)", "FROM q2 SEMI JOIN q3 USING (qid))").replace("q2 AS (", "q3 AS (SELECT qid FROM q1 WHERE array_to_string(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda t: length(t) >= 5), ' ') NOT IN ('', text)),\nq2 AS (", 1)
    + _FUSED.format("1.0", "1.0") + "SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM fused",
)
def fan_out_search(spark, d):
    """Each item and its cached paraphrase, searched in one plan and fused."""
    q = items(spark, d)
    cache = q.join(long_words(q).withColumnRenamed("text", "long"), "qid").select(T.cache_key(F.lit("multi"), F.lit(""), F.col("text")).alias("key"), F.array("long").alias("texts"))
    return rounded(rewrites.search_fan_out(rewrites.fan_out(q, cache, "multi"), index_of(spark, d)), "score", places=6)


# ---- legs ------------------------------------------------------------------------------------------------------


def hashed_bag(rows: DataFrame, key: str) -> DataFrame:
    """A stand-in for an encoder: how many tokens of a text fall into each of 16 buckets."""
    buckets = F.transform(T.tokens(F.col("text")), lambda t: (F.conv(F.substring(F.md5(t), 1, 2), 16, 10).cast("int") % 16))
    counts = T.let(buckets, lambda found: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.size(F.filter(found, lambda b: b == i)).cast("double")))
    return stored(rows.select(key, counts.alias("vector")), "vectors")


_BAG = r"list_transform(range(16), lambda i: CAST(len(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+'), lambda t: CAST('0x' || substr(md5(t), 1, 2) AS INTEGER) % 16), lambda b: b = i)) AS DOUBLE))"


_BAG_LEG = f""",
dv AS (SELECT doc_id, {_BAG} AS v FROM documents), qv AS (SELECT qid, {_BAG} AS v FROM q1),
l2 AS (SELECT * FROM (SELECT qid, doc_id, list_dot_product(qv.v, dv.v) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(list_dot_product(qv.v, dv.v), 8) DESC, doc_id) AS rank FROM qv, dv) WHERE rank <= K_HITS)
"""


@query(
    "hybrid_plan",
    _BASE + _leg("l1", "q1") + _BAG_LEG.replace("K_HITS", "20") + _FUSED.format("1.0", "1.0") + "SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM fused",
)
def hybrid_plan(spark, d):
    """A lexical and a dense leg by configuration."""
    docs = table(spark, d, "documents")
    plan = SearchPlan(index_of(spark, d), hashed_bag(docs, "doc_id"), lambda q: hashed_bag(q, "qid"))
    return rounded(plan.run(items(spark, d), docs), "score", places=6)


_blocks: dict[tuple[str, str], vector_blocks.VectorBlocks] = {}


def bag_blocks(spark, d) -> vector_blocks.VectorBlocks:
    """The documents' stand-in vectors in blocks; the first query of an application that asks for them writes them."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _blocks:
        _blocks[key] = vector_blocks.write_blocks(hashed_bag(table(spark, d, "documents"), "doc_id"))
    return _blocks[key]


@query("rrf_weight_sweep_dense", _BASE + _leg("l1", "q1", 50) + _BAG_LEG.replace("K_HITS", "50") + _SWEEP.replace("w_full", "w_lexical").replace("w_long", "w_dense"))
def rrf_weight_sweep_dense(spark, d):
    """A lexical leg against a dense one from stored blocks."""
    legs = SearchPlan(index_of(spark, d), bag_blocks(spark, d), lambda q: hashed_bag(q, "qid"), retrieve_k=50).legs(items(spark, d))
    return sweep(spark, d, {"lexical": legs["full"], "dense": legs["full_dense"]})


@query("rerank_normalised", _BASE + _leg("l1", "q1") + _RERANK + "SELECT qid, doc_id, round(1 / (1 + exp(-score)), 6) AS score, CAST(rank AS INTEGER) AS rank FROM rr")
def rerank_normalised(spark, d):
    return rounded(rank.rerank(leg(spark, d), items(spark, d), table(spark, d, "documents"), 10, normalise=True), "score", places=6)


def overlap_model() -> PairModel:
    """The stand-in of ``overlap_score`` as a model in Python."""

    def load():
        import regex

        word = regex.compile(T.TOKEN)

        def score(pairs):
            sides = [(set(word.findall(q)), set(word.findall(t))) for q, t in pairs]
            return [len(q & t) / len(q) if q else 0.0 for q, t in sides]

        return score

    return PairModel("overlap", load)


@query("rerank_in_batches", _BASE + _leg("l1", "q1") + _RERANK + "SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rr")
def rerank_in_batches(spark, d):
    """Re-ranking by a model that is loaded once a worker and sees batches of like lengths."""
    return rounded(rank.rerank(leg(spark, d), items(spark, d), table(spark, d, "documents"), 10, overlap_model()), "score", places=6)


# ---- caches ----------------------------------------------------------------------------------------------------


_ENCODED = "SELECT substr(sha256('m1' || chr(1) || text), 1, 16) AS key, [CAST(length(text) AS DOUBLE), max(CASE WHEN item_id % 2 = 0 THEN 1.0 ELSE 0.0 END)] AS vector FROM benchmark GROUP BY text"


@query("encode_with_cache", _ENCODED)
def encode_with_cache(spark, d):
    """Half of the texts are in the cache (marked 1), the encoder sees the others."""
    rows = items(spark, d)
    vector = lambda mark: F.array(F.length("text").cast("double"), F.lit(mark))
    cache = rows.where("qid % 2 = 0").select(T.row_key(F.lit("m1"), F.col("text")).alias("key"), vector(1.0).alias("vector")).dropDuplicates(["key"])
    return rewrites.encode_cached(rows, cache, lambda new: new.select("key", vector(0.0).alias("vector")), "m1")


@query("encode_through_cache", _ENCODED)
def encode_through_cache(spark, d):
    """Half of the texts are encoded into a stored cache (marked 1); a second run encodes the others and reads all from there."""
    rows = items(spark, d).withColumn("key", T.row_key(F.lit("m1"), F.col("text")))
    make = lambda mark: lambda new: new.select("key", F.array(F.length("text").cast("double"), F.lit(mark)).alias("vector"))
    empty = new_cache(spark, scratch_path(spark, "cache"), "vector array<double>", buckets=16)
    _, cache = through_cache(rows.where("qid % 2 = 0").select("key", "text"), empty, make(1.0))
    return through_cache(rows.select("key", "text"), cache, make(0.0))[0]


@query("corpus_key", "SELECT substr(sha256('m1|' || count(*) || '|' || CAST(sum(CAST('0x' || substr(sha256(coalesce(text, '')), 1, 15) AS HUGEINT)) AS VARCHAR)), 1, 16) AS key FROM documents")
def corpus_key(spark, d):
    return T.corpus_key(table(spark, d, "documents"), "m1", "text")


# ---- reports ---------------------------------------------------------------------------------------------------


@query("first_misses", _BASE + _leg("l1", "q1", 10) + "SELECT qid, text FROM q1 WHERE qid NOT IN (SELECT qid FROM l1 SEMI JOIN gold USING (qid, doc_id)) ORDER BY qid LIMIT 10")
def first_misses(spark, d):
    return metrics.first_misses(leg(spark, d, k=10), items(spark, d), gold(spark, d))


_TWO_RUNS = LEGS + _metrics_sql("l1", "(10)") + _metrics_sql("l2", "(10)").replace(",\ng AS (SELECT qid, count(*) AS n_gold FROM (SELECT DISTINCT qid, doc_id FROM gold) GROUP BY qid),", ",", 1)


@query(
    "report_table",
    _TWO_RUNS + """,
x AS (SELECT 1 AS position, 'full' AS label, count(*) AS n, avg(recall) AS recall, avg(ndcg) AS ndcg, avg(mrr) AS mrr FROM l1_m UNION ALL SELECT 2, 'long', count(*), avg(recall), avg(ndcg), avg(mrr) FROM l2_m)
SELECT position, format('| {} | {} | {:.3f} | {:.3f} | {:.3f} | {}ms |', label, n, recall, ndcg, mrr, position * 5) AS line FROM x
UNION ALL SELECT 3, '| absent | — | — | — | — | — |' UNION ALL SELECT 1073741824, (SELECT format('best: {}, R@10={:.3f}', label, recall) FROM x ORDER BY recall DESC, position LIMIT 1)""",
)
def report_table(spark, d):
    """Two runs and one without results; the milliseconds are given."""
    configs = frame(spark, [(1, "full", "a"), (2, "long", "b"), (3, "absent", "c")], "position int, label string, run string")
    results = None
    for i, (run, per) in enumerate(zip("ab", _per_query_of_both(spark, d).values()), 1):
        part = metrics.macro(per).where("k = 10").select(F.lit(run).alias("run"), "n", "recall", "ndcg", "mrr", F.lit(5.0 * i).alias("ms"))
        results = part if results is None else results.unionByName(part)
    return metrics.report_lines(configs, results)


@query(
    "running_ids",
    r"WITH u AS (SELECT conv_id, turn, text, lower(regexp_replace(text, '\s+', '', 'g')) AS key FROM conversations WHERE role = 'user' AND text IS NOT NULL), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY conv_id, turn) AS nth FROM u)"
    " SELECT format('q_{:04d}', row_number() OVER (ORDER BY conv_id, turn) - 1) AS qid, text FROM f WHERE nth = 1",
)
def running_ids(spark, d):
    """Queries in the order in which they are first seen, with running ids."""
    users = table(spark, d, "conversations").where("role = 'user' and text is not null").select("conv_id", "turn", "text")
    first = evalsets.first_seen(users, T.query_key(F.col("text")), "conv_id", "turn")
    return evalsets.numbered(first, "conv_id", "turn").select(F.format_string("q_%04d", "number").alias("qid"), "text")
