"""Evaluation sets: batch answers decoded, sources merged, samples, consistency checks and descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evalsets as E
from . import query, table
from .filters import _SES, slots

def _joined(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@query(
    "batch_flatten_chat",
    "SELECT c_custkey AS id, 'topic' AS kind, c_mktsegment AS query FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'colloquial', c_name FROM customer WHERE c_custkey % 3 = 0",
)
def batch_flatten_chat(spark, d):
    """Answers about customers as lines of a batch: one that decodes, one whose content is broken, one that is no JSON."""
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    whole = _joined('{"response": {"body": {"choices": [{"message": {"content": "{\\"topic\\": \\"', segment, '\\", \\"constraint\\": \\" \\", \\"colloquial\\": \\"', name, '\\"}"}}]}}}')
    broken = _joined('{"response": {"body": {"choices": [{"message": {"content": "', name, '"}}]}}}')
    line = F.when(F.col("c_custkey") % 3 == 0, whole).when(F.col("c_custkey") % 3 == 1, broken).otherwise(name)
    return E.personas(E.chat_answers(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), line.alias("line"))))


@query("batch_flatten_blocks", "SELECT c_custkey AS id, 'topic' AS kind, c_name AS query FROM customer WHERE c_custkey % 2 = 0")
def batch_flatten_blocks(spark, d):
    """The same in blocks of text that make one document together; every second answer failed."""
    name = F.col("c_name")
    whole = _joined('{"result": {"type": "succeeded", "message": {"content": [{"type": "text", "text": "{\\"topic\\": "}, {"type": "text", "text": "\\"', name, '\\"}"}]}}}')
    line = F.when(F.col("c_custkey") % 2 == 0, whole).otherwise('{"result": {"type": "errored"}}')
    return E.personas(E.block_answers(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), line.alias("line"))))


@query(
    "decode_polymorphic",
    "SELECT o_orderkey AS id, o_orderpriority AS query FROM orders WHERE o_orderkey % 5 < 4 UNION ALL SELECT o_orderkey, 'order ' || o_orderstatus FROM orders WHERE o_orderkey % 5 = 0",
)
def decode_polymorphic(spark, d):
    """A list, an object, or a wrapped list, of texts or objects: texts of five characters or more."""
    said = F.col("o_orderpriority")
    shapes = [_joined('["', said, '", "abc", "order ', F.col("o_orderstatus"), '"]'), _joined('{"queries": ["', said, '"]}'), _joined('{"query": "', said, '"}'), _joined('[{"query": "', said, '"}]'), said]
    answer = F.element_at(F.array(*shapes), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return E.listed_texts(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), answer.alias("answer")), "query")


_MERGED = r"""
WITH u AS (SELECT conv_id % 50 AS gold, text AS query, 'one' AS source, 0 AS o FROM conversations WHERE role = 'user' AND turn = 0
  UNION ALL SELECT conv_id % 50, text || ' ', 'two', 1 FROM conversations WHERE role = 'user'),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gold, lower(regexp_replace(query, '\s+', '', 'g')) ORDER BY o, query) AS nth FROM u) WHERE nth = 1)
"""


def merged(spark, d) -> DataFrame:
    users = table(spark, d, "conversations").where("role = 'user'")
    gold = (F.col("conv_id") % 50).alias("gold")
    return E.merge_sources({"one": users.where("turn = 0").select(gold, F.col("text").alias("query")), "two": users.select(gold, F.concat("text", F.lit(" ")).alias("query"))})


@query("merge_dedupe_eval", _MERGED + "SELECT gold, query, source FROM m")
def merge_dedupe_eval(spark, d):
    return merged(spark, d).select("gold", "query", "source")


@query("merge_counters", _MERGED + "SELECT source, count(*) AS n, count(DISTINCT gold) AS n_gold, round(count(*) / (SELECT count(*) FROM m), 6) AS share FROM m GROUP BY source")
def merge_counters(spark, d):
    rows = merged(spark, d)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    counted = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gold").alias("n_gold"))
    return counted.crossJoin(F.broadcast(total)).select("source", "n", "n_gold", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("stratified_sample", "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS nth FROM documents) WHERE nth <= CASE lang WHEN 'en' THEN 50 WHEN 'fr' THEN 30 WHEN 'de' THEN 20 ELSE 0 END")
def stratified_sample(spark, d):
    return E.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", {"en": 0.5, "fr": 0.3, "de": 0.2}, 100)


@query("hash_sample", "SELECT doc_id FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 100")
def hash_sample(spark, d):
    return E.hash_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 100, "7")


@query("objective_smoke_set", r"SELECT 'smoke-' || doc_id AS qid, s AS query, doc_id AS gold FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[。！？!?\n]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) BETWEEN 8 AND 80)[1] AS s FROM documents) WHERE s IS NOT NULL ORDER BY md5('42|' || doc_id), doc_id LIMIT 200")
def objective_smoke_set(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("query")).where("query is not null")
    return E.hash_sample(rows, "doc_id", 200).select(F.concat(F.lit("smoke-"), "doc_id").alias("qid"), "query", F.col("doc_id").alias("gold"))


@query(
    "synth_conditions",
    "WITH l AS (SELECT list(DISTINCT lang ORDER BY lang) AS langs FROM documents), x AS (SELECT doc_id, lang, list_filter(langs, lambda y: y <> lang) AS others, CAST('0x' || substr(md5('no|' || doc_id), 1, 8) AS BIGINT) AS h FROM documents, l) SELECT doc_id, lang AS must_lang, others[1 + h % len(others)] AS must_not_lang FROM x",
)
def synth_conditions(spark, d):
    """A condition from the document's own value, and a negated one from the other values, picked by hash."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    langs = docs.agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    rows = docs.crossJoin(F.broadcast(langs))
    return rows.select("doc_id", F.col("lang").alias("must_lang"), E.pick(F.array_except("langs", F.array("lang")), "no", F.col("doc_id")).alias("must_not_lang"))


@query("complexity_label", "SELECT label, count(*) AS n FROM (SELECT CASE WHEN quality + toxic + doc_id % 2 <= 1 THEN 'single' WHEN quality + toxic + doc_id % 2 = 2 THEN 'multi' ELSE 'complex' END AS label FROM labels) GROUP BY label")
def complexity_label(spark, d):
    label = E.complexity(F.col("quality") + F.col("toxic"), F.col("doc_id") % 2)
    return table(spark, d, "labels").select(label.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("task_dedupe", "SELECT key, min(doc_id) AS doc_id FROM (SELECT md5(lang || '|' || source) AS key, doc_id FROM documents) WHERE key NOT IN (SELECT md5(lang || '|' || source) FROM documents WHERE lang = 'es') GROUP BY key")
def task_dedupe(spark, d):
    """Tasks by content key, the first of each, without those that are done."""
    rows = table(spark, d, "documents").select("doc_id", "lang", F.md5(F.concat_ws("|", "lang", "source")).alias("key"))
    return E.first_seen(rows, F.col("key"), "doc_id").join(rows.where("lang = 'es'").select("key"), "key", "left_anti").select("key", "doc_id")


# ---- consistency of gold with the conditions that a query states ------------------------------------------------


_CHECK = _SES + """,
t AS (SELECT slot, count(w) AS n, bool_or(w IN (1, 2, 3, 4, 5)) AS on_week, bool_or(b > 9 AND a < 18) AS in_hours FROM u LEFT JOIN e USING (slot) GROUP BY slot),
r AS (SELECT slot, n = 0 AS missing, NOT coalesce(on_week, false) AS weekday, NOT coalesce(in_hours, false) AS hour, slot LIKE '%7/%' AS kind FROM t)
"""


def checked(spark, d) -> DataFrame:
    """slot and its failing checks: sessions there, on a working day, in office hours, of an allowed kind."""
    s = F.col("sessions")
    reasons = {
        "not_in_db": F.size(s) == 0,
        "weekday": ~F.exists(s, lambda x: x["weekday"] <= 5),
        "hour": ~F.exists(s, lambda x: (x["end_hour"] > 9) & (x["start_hour"] < 18)),
        "kind": F.col("slot").like("%7/%"),
    }
    return slots(spark, d).select("slot", E.inconsistencies(reasons).alias("reasons"))


@query("gold_consistency_first", _CHECK + "SELECT slot, CASE WHEN missing THEN 'not_in_db' WHEN weekday THEN 'weekday' WHEN hour THEN 'hour' WHEN kind THEN 'kind' END AS reason FROM r")
def gold_consistency_first(spark, d):
    return checked(spark, d).select("slot", F.try_element_at("reasons", F.lit(1)).alias("reason"))


@query("gold_consistency_all", _CHECK + "SELECT slot, array_to_string(list_filter([CASE WHEN missing THEN 'not_in_db' END, CASE WHEN weekday THEN 'weekday' END, CASE WHEN hour THEN 'hour' END, CASE WHEN kind THEN 'kind' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r")
def gold_consistency_all(spark, d):
    return checked(spark, d).select("slot", F.array_join("reasons", ",").alias("reasons"))


@query("clean_eval_set", _CHECK + "SELECT slot FROM r WHERE NOT (missing OR weekday OR hour OR kind)")
def clean_eval_set(spark, d):
    rows = checked(spark, d)
    return slots(spark, d).select("slot").join(rows.where(F.size("reasons") > 0), "slot", "left_anti")


@query("drop_reasons", _CHECK + "SELECT reason, count(*) AS n FROM (SELECT 'not_in_db' AS reason FROM r WHERE missing UNION ALL SELECT 'weekday' FROM r WHERE weekday UNION ALL SELECT 'hour' FROM r WHERE hour UNION ALL SELECT 'kind' FROM r WHERE kind) GROUP BY reason")
def drop_reasons(spark, d):
    return checked(spark, d).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---- descriptions ----------------------------------------------------------------------------------------------


@query("eda_summary", "SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(text, '') = '') AS missing, round(avg(length(coalesce(text, ''))), 4) AS mean_len, CAST(floor(quantile_cont(length(coalesce(text, '')), 0.5)) AS BIGINT) AS median_len, CAST(floor(quantile_cont(length(coalesce(text, '')), 0.9)) AS BIGINT) AS p90_len, max(length(coalesce(text, ''))) AS max_len FROM documents")
def eda_summary(spark, d):
    return E.describe_text(table(spark, d, "documents"), "text")


@query("eda_value_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def eda_value_counts(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("eda_length_quantiles", "SELECT lang, round(quantile_cont(n_chars, 0.5), 4) AS median_chars, round(quantile_cont(n_chars, 0.9), 4) AS p90_chars, max(n_chars) AS max_chars, count(*) FILTER (WHERE n_chars = 0) AS zero FROM documents GROUP BY lang")
def eda_length_quantiles(spark, d):
    q = lambda p: F.round(F.percentile("n_chars", F.lit(p)), 4)
    return table(spark, d, "documents").groupBy("lang").agg(q(0.5).alias("median_chars"), q(0.9).alias("p90_chars"), F.max("n_chars").alias("max_chars"), F.count_if(F.col("n_chars") == 0).alias("zero"))


@query("group_size_distribution", "SELECT n, count(*) AS n_groups FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY n")
def group_size_distribution(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("n_groups"))


@query("missing_by_column", "SELECT 'lang' AS column_name, count(*) FILTER (WHERE coalesce(lang, '') = '') AS missing FROM documents UNION ALL SELECT 'source', count(*) FILTER (WHERE coalesce(source, '') = '') FROM documents UNION ALL SELECT 'text', count(*) FILTER (WHERE coalesce(text, '') = '') FROM documents")
def missing_by_column(spark, d):
    names = ("lang", "source", "text")
    counted = table(spark, d, "documents").agg(*(F.count_if(F.coalesce(c, F.lit("")) == "").alias(c) for c in names))
    return counted.select(F.explode(F.create_map(*(x for c in names for x in (F.lit(c), F.col(c))))).alias("column_name", "missing"))
