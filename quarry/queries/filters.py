"""Sessions, the two filter families, pools and filters around ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsers
from ..operators import bitmaps as B
from ..operators import lexical, metrics, rank
from ..operators import predicates as P
from ..plans.search import SearchPlan
from ..schema import CONDITIONS, CONSTRAINTS
from ..session import stored
from ..sizes import small
from . import query, table
from .retrieval import K, _BASE, _leg, _metrics_sql, gold, index_of, items, rounded

_SES = """
WITH e AS (SELECT DISTINCT concat(user_id, '/', event_type) AS slot, isodow(ts) AS w, hour(ts) AS a, hour(ts) + 1 AS b FROM events),
u AS (SELECT DISTINCT slot FROM e UNION SELECT DISTINCT concat(user_id, '/none') FROM events)
"""


def slots(spark, d) -> DataFrame:
    """slot, sessions: the weekly hours of each user's events of a type; and a slot without sessions for each user."""
    events = table(spark, d, "events")
    hour = F.hour("ts")
    session = F.struct((F.weekday("ts") + 1).alias("weekday"), hour.alias("start_hour"), (hour + 1).alias("end_hour"))
    busy = events.groupBy(F.concat_ws("/", "user_id", "event_type").alias("slot")).agg(F.array_sort(F.collect_set(session)).alias("sessions"))
    idle = events.select(F.concat_ws("/", "user_id", F.lit("none")).alias("slot")).distinct()
    return busy.unionByName(idle.withColumn("sessions", F.array().cast(busy.schema["sessions"].dataType)))


def ints(*values: int):
    return F.array(*map(F.lit, values))


def _slot_query(name: str, condition, sql: str):
    @query(name, _SES + sql)
    def run(spark, d):
        return slots(spark, d).where(condition(F.col("sessions"))).select("slot")


@query("sessions_by_user", _SES + "SELECT slot, count(w) AS n_sessions, coalesce(string_agg(w || ' ' || a || '-' || b, ',' ORDER BY w, a), '') AS sessions FROM u LEFT JOIN e USING (slot) GROUP BY slot")
def sessions_by_user(spark, d):
    text = F.transform("sessions", lambda s: F.concat(s["weekday"], F.lit(" "), s["start_hour"], F.lit("-"), s["end_hour"]))
    return slots(spark, d).select("slot", F.size("sessions").cast("long").alias("n_sessions"), F.array_join(text, ",").alias("sessions"))


@query(
    "day_part_flags",
    _SES + "SELECT slot, coalesce(bool_or(a >= 8 AND a < 12), false) AS has_morning, coalesce(bool_or(a >= 12 AND a < 13), false) AS has_noon, coalesce(bool_or(a >= 13 AND a < 18), false) AS has_afternoon, coalesce(bool_or(a >= 18), false) AS has_evening, coalesce(string_agg(DISTINCT CAST(w AS VARCHAR), ',' ORDER BY CAST(w AS VARCHAR)), '') AS weekdays FROM u LEFT JOIN e USING (slot) GROUP BY slot",
)
def day_part_flags(spark, d):
    from ..operators.catalog import day_parts

    return day_parts(slots(spark, d)).select("slot", "has_morning", "has_noon", "has_afternoon", "has_evening", F.array_join("weekdays", ",").alias("weekdays"))


@query("session_text", _SES + "SELECT slot, coalesce(string_agg('星期' || substr('一二三四五六日', CAST(w AS INTEGER), 1) || ' ' || a || ':00-' || b || ':00', '、' ORDER BY w, a), '未定') AS text FROM u LEFT JOIN e USING (slot) GROUP BY slot")
def session_text(spark, d):
    from ..operators.catalog import session_text as as_text

    return slots(spark, d).select("slot", as_text(F.col("sessions")).alias("text"))


_slot_query("filter_weekday_incl", lambda s: P.weekday_included(s, ints(1, 2)), "SELECT slot FROM u WHERE slot IN (SELECT slot FROM e WHERE w IN (1, 2))")
_slot_query("filter_weekday_excl", lambda s: P.weekday_excluded(s, ints(3, 6)), "SELECT slot FROM u WHERE slot NOT IN (SELECT slot FROM e WHERE w IN (3, 6))")
_slot_query("filter_hour_overlap", lambda s: P.hours_overlap(s, F.lit(9), F.lit(11)), "SELECT slot FROM u WHERE slot NOT IN (SELECT slot FROM e) OR slot IN (SELECT slot FROM e WHERE b > 9 AND a < 11)")
_slot_query(
    "filter_hour_exclude_all",
    lambda s: P.outside_ranges(s, F.array(F.struct(F.lit(8).alias("low"), F.lit(18).alias("high")), F.struct(F.lit(0).alias("low"), F.lit(9).alias("high")))),
    "SELECT slot FROM u WHERE slot NOT IN (SELECT slot FROM e GROUP BY slot HAVING bool_and(a >= 8 AND b <= 18) OR bool_and(a >= 0 AND b <= 9))",
)
_slot_query("compile_hour_exists", lambda s: P.hour_clause(s, ints(9, 11)), "SELECT DISTINCT slot FROM e WHERE a < 11 AND b > 9")
_slot_query("compile_weekday_overlap", lambda s: P.weekday_clause(F.array_distinct(F.transform(s, lambda x: x["weekday"])), ints(2, 4)), "SELECT DISTINCT slot FROM e WHERE w IN (2, 4)")
_slot_query("compile_must_not_hour", lambda s: ~P.hour_clause(s, ints(9, 21)), "SELECT slot FROM u WHERE slot NOT IN (SELECT slot FROM e WHERE a < 21 AND b > 9)")


def strings(*values: str):
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


@query("filter_lang", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr', 'es') AND lang NOT IN ('fr')")
def filter_lang(spark, d):
    return table(spark, d, "documents").where(P.value_in(F.col("lang"), strings("en", "fr", "es"), strings("fr"))).select("doc_id", "lang")


@query("filter_kind", "SELECT d.doc_id, coalesce(quality, 0) AS kind FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(quality, 0) IN (0, 1) AND coalesce(quality, 0) NOT IN (1)")
def filter_kind(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    kind = F.coalesce("quality", F.lit(0))
    return docs.where(P.value_in(kind, ints(0, 1), ints(1))).select("doc_id", kind.alias("kind"))


@query("filter_point_range", "SELECT p_partkey FROM part WHERE coalesce(p_retailprice, 0) BETWEEN 950 AND 1500")
def filter_point_range(spark, d):
    return table(spark, d, "part").where(P.in_range(F.col("p_retailprice"), F.lit(950.0), F.lit(1500.0))).select("p_partkey")


@query("filter_unit_substring", "SELECT p_partkey, p_name FROM part WHERE (contains(p_name, 'blue') OR contains(p_name, 'an')) AND NOT contains(p_name, 'anvil')")
def filter_unit_substring(spark, d):
    unit = F.col("p_name")
    return table(spark, d, "part").where(P.contains_any(unit, strings("blue", "an")) & ~P.contains_any(unit, strings("anvil"))).select("p_partkey", "p_name")


@query("compile_lang_any", "SELECT doc_id FROM documents WHERE lang IN ('de', 'es')")
def compile_lang_any(spark, d):
    return table(spark, d, "documents").where(P.lang_clause(F.col("lang"), strings("de", "es"))).select("doc_id")


@query("compile_point_eq", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 17")
def compile_point_eq(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_quantity") == 17).select("l_orderkey", "l_linenumber")


@query("compile_kind_map", "SELECT doc_id FROM labels WHERE quality + 1 IN (1)")
def compile_kind_map(spark, d):
    wanted = P.kind_numbers(strings("必修", "未知"))
    return table(spark, d, "labels").where(F.array_contains(wanted, F.col("quality") + 1)).select("doc_id")


@query("compile_like_any", "SELECT p_partkey FROM part WHERE p_type LIKE '%ECON%' OR p_type LIKE '%S_A%L%'")
def compile_like_any(spark, d):
    return table(spark, d, "part").where(P.unit_clause(F.col("p_type"), strings("ECON", "S_A%L"))).select("p_partkey")


@query("compile_must_not", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE lang IN ('en', 'de', 'fr') AND NOT lang IN ('fr') AND NOT (quality + 1 IN (1)) AND NOT (source LIKE '%src1%' OR source LIKE '%%2%')")
def compile_must_not(spark, d):
    """Negated clauses drop rows whose attribute is null, here documents without a label."""
    none = "array()"
    side = f"named_struct('course_lang', {{}}, 'weekday', {none}, 'hour_range', {none}, 'point', null, 'kind', {{}}, 'lmt_kind', {none}, 'unit', {{}})"
    must = F.expr(side.format("array('en', 'de', 'fr')", none, none)).cast(CONDITIONS)
    must_not = F.expr(side.format("array('fr')", "array('必修', '未知')", "array('src1', '%2')")).cast(CONDITIONS)
    doc = {c: F.col(c) for c in ("lang", "unit", "kind", "sessions", "weekdays", "point", "lmt_kind")}
    return catalog(spark, d).where(P.matches(doc, must, must_not)).select("doc_id")


# ---- documents under conditions --------------------------------------------------------------------------------


def conditions(spark, d) -> DataFrame:
    """qid, must, must_not: conditions that vary with the item's id; a quarter of the items have none."""
    empty = "array()"
    must = f"named_struct('course_lang', case qid % 4 when 1 then array('en') when 3 then array('de', 'es') else {empty} end, 'weekday', {empty}, 'hour_range', {empty}, 'point', null, 'kind', if(qid % 8 = 3, array('必修'), {empty}), 'lmt_kind', {empty}, 'unit', if(qid % 4 = 2, array('src1'), {empty}))"
    must_not = f"named_struct('course_lang', if(qid % 4 = 2, array('fr'), {empty}), 'weekday', {empty}, 'hour_range', {empty}, 'point', null, 'kind', {empty}, 'lmt_kind', {empty}, 'unit', if(qid % 8 = 1, array('src2'), {empty}))"
    return items(spark, d).select("qid", F.expr(must).cast(CONDITIONS).alias("must"), F.expr(must_not).cast(CONDITIONS).alias("must_not"))


def catalog(spark, d) -> DataFrame:
    """doc_id with the attributes that conditions speak of; kind is quality + 1 where a label exists."""
    labels = table(spark, d, "labels").select("doc_id", (F.col("quality") + 1).alias("kind"))
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("source").alias("unit")).join(labels, "doc_id", "left")
    return docs.selectExpr("*", "cast(array() as array<struct<weekday:int,start_hour:int,end_hour:int>>) as sessions", "cast(array() as array<int>) as weekdays", "cast(null as double) as point", "cast(null as string) as lmt_kind")


_ATTRIBUTES = ("lang", "unit", "kind", "sessions", "weekdays", "point", "lmt_kind")
_bits: dict[tuple[str, str], DataFrame] = {}


def attribute_bits(spark, d) -> DataFrame:
    """The bitmaps of the catalog's attributes; the first query of an application that asks for them writes them."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _bits:
        _bits[key] = stored(B.attribute_bits(catalog(spark, d), index_of(spark, d), {c: F.col(c) for c in _ATTRIBUTES}), "bits")
    return _bits[key]


def pool(spark, d):
    """The documents that meet each query's conditions, as masks; queries without conditions are not restricted."""
    return B.pools(conditions(spark, d), attribute_bits(spark, d))


_POOL = """
c AS (SELECT d.doc_id, d.lang, d.source AS unit, l.quality + 1 AS kind FROM documents d LEFT JOIN labels l USING (doc_id)),
pool AS (SELECT item_id AS qid, doc_id FROM benchmark, c WHERE
  CASE item_id % 4 WHEN 1 THEN lang = 'en' AND (item_id % 8 <> 1 OR NOT unit LIKE '%src2%') WHEN 2 THEN unit LIKE '%src1%' AND NOT lang = 'fr'
  WHEN 3 THEN lang IN ('de', 'es') AND (item_id % 8 <> 3 OR kind = 1) ELSE true END)
"""


@query("prefilter_pool", "WITH " + _POOL + "SELECT qid, doc_id FROM pool")
def prefilter_pool(spark, d):
    """The pools written out, which only a report needs."""
    return B.pool_members(items(spark, d), pool(spark, d), index_of(spark, d))


@query(
    "pool_stats",
    "WITH " + _POOL + """, gold AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
n AS (SELECT item_id AS qid, count(doc_id) AS n FROM benchmark LEFT JOIN pool ON qid = item_id GROUP BY item_id)
SELECT count(*) AS n_queries, round(avg(n), 6) AS avg_pool, (list(n ORDER BY n))[count(*) // 2 + 1] AS median_pool, min(n) AS min_pool, max(n) AS max_pool,
  (SELECT round(count(*) FILTER (WHERE p.doc_id IS NOT NULL) / count(*), 6) FROM gold g LEFT JOIN pool p ON g.qid = p.qid AND g.doc_id = p.doc_id) AS gold_in_pool FROM n""",
)
def pool_stats(spark, d):
    """Sizes of the pools, with the upper median, and the share of gold that they hold."""
    from ..operators.evalsets import pool_statistics

    pools, index = pool(spark, d), index_of(spark, d)
    return pool_statistics(B.pool_sizes(items(spark, d), pools, index), B.in_pool(gold(spark, d), pools, index))


@query(
    "pool_by_dims",
    "WITH " + _POOL + """, n AS (SELECT item_id AS qid, count(doc_id) AS n FROM benchmark LEFT JOIN pool ON qid = item_id GROUP BY item_id),
dm AS (SELECT qid, n, CASE qid % 4 WHEN 1 THEN 'course_lang' || CASE WHEN qid % 8 = 1 THEN ',not unit' ELSE '' END WHEN 2 THEN 'not course_lang,unit' WHEN 3 THEN 'course_lang' || CASE WHEN qid % 8 = 3 THEN ',kind' ELSE '' END ELSE '' END AS dims FROM n)
SELECT dims, count(*) AS n_queries, round(avg(n), 6) AS avg_pool FROM dm GROUP BY dims ORDER BY n_queries DESC, dims LIMIT 15""",
)
def pool_by_dims(spark, d):
    """The 15 most frequent combinations of dimensions, with their average pool."""
    names = ("course_lang", "weekday", "hour_range", "kind", "lmt_kind", "unit")
    present = [F.when(F.size(f"{side}.{n}") > 0, F.lit(("not " if side == "must_not" else "") + n)) for side in ("must", "must_not") for n in names]
    dims = conditions(spark, d).select("qid", F.array_join(F.array_sort(F.array_compact(F.array(*present))), ",").alias("dims"))
    sizes = B.pool_sizes(items(spark, d), pool(spark, d), index_of(spark, d))
    out = dims.join(sizes, "qid").groupBy("dims").agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("n"), 6).alias("avg_pool"))
    return out.orderBy(F.desc("n_queries"), "dims").limit(15)


_PRE = _BASE.replace("gold AS (", _POOL.strip() + ",\ngold AS (") + _leg("l1", "q1", 10, "WHERE (qid, p.doc_id) IN (SELECT (qid, doc_id) FROM pool)")


@query("prefilter_ranking", _PRE + "SELECT qid, doc_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM l1")
def prefilter_ranking(spark, d):
    """The pool cuts between scoring and ranking; the statistics stay those of the corpus."""
    plan = SearchPlan(index_of(spark, d), retrieve_k=10, top_k=10, allowed=pool(spark, d))
    return rounded(plan.run(items(spark, d), table(spark, d, "documents")), "score")


@query("prefilter_variants", _PRE.replace("l1", "l2") + _leg("l1", "q1", 10) + ", v AS (SELECT 'no_filter' AS variant, * FROM l1 UNION ALL SELECT 'oracle', * FROM l2), s AS (SELECT 'no_filter' AS variant, CAST((SELECT count(*) FROM documents) AS DOUBLE) AS avg_pool UNION ALL SELECT 'oracle', (SELECT count(*) FROM pool) / (SELECT count(*) FROM q1)) SELECT variant, round(avg_pool, 4) AS avg_pool, round((SELECT count(DISTINCT qid) FROM v SEMI JOIN gold USING (qid, doc_id) WHERE v.variant = s.variant) / (SELECT count(*) FROM q1), 6) AS hit_rate FROM s")
def prefilter_variants(spark, d):
    """Hit rate at 10 and average pool, without and with the conditions."""
    queries, docs, allowed, qrels = items(spark, d), table(spark, d, "documents"), pool(spark, d), gold(spark, d)
    n = queries.agg(F.count(F.lit(1)).alias("n"))
    sizes = {"no_filter": docs.agg(F.count(F.lit(1)).cast("double").alias("avg_pool")), "oracle": B.pool_sizes(queries, allowed, index_of(spark, d)).agg(F.avg("n").alias("avg_pool"))}
    out = None
    for name, cut in {"no_filter": None, "oracle": allowed}.items():
        hits = lexical.bm25_search(queries, index_of(spark, d), 10, cut).join(qrels, ["qid", "doc_id"], "left_semi").agg(F.count_distinct("qid").alias("found"))
        part = hits.crossJoin(n).crossJoin(sizes[name]).select(F.lit(name).alias("variant"), F.round("avg_pool", 4).alias("avg_pool"), F.round(F.col("found") / F.col("n"), 6).alias("hit_rate"))
        out = part if out is None else out.unionByName(part)
    return out


_NAMES = {"en": "英文", "fr": "法文", "de": "德文", "es": "西班牙文"}


@query(
    "prefilter_parsed",
    _BASE.replace("gold AS (", "pool AS (SELECT item_id AS qid, doc_id FROM benchmark, documents WHERE CASE item_id % 3 WHEN 1 THEN lang = 'en' WHEN 2 THEN lang <> 'fr' ELSE true END),\ngold AS (") + _leg("l1", "q1", 10, "WHERE (qid, p.doc_id) IN (SELECT (qid, doc_id) FROM pool)")
    + "SELECT 'parser' AS variant, round((SELECT count(*) FROM pool) / (SELECT count(*) FROM q1), 4) AS avg_pool, round((SELECT count(DISTINCT qid) FROM l1 SEMI JOIN gold USING (qid, doc_id)) / (SELECT count(*) FROM q1), 6) AS hit_rate",
)
def prefilter_parsed(spark, d):
    """The variant whose conditions are parsed from what a query says: two thirds of the items ask for a language or rule one out."""
    queries = items(spark, d)
    said = F.expr("case qid % 3 when 1 then '英文授課' when 2 then '不要法文' else '' end")
    must, must_not = parsers.parse_patterns(F.col("said"))
    wanted = queries.select("qid", said.alias("said")).select("qid", must.alias("must"), must_not.alias("must_not"))
    index = index_of(spark, d)
    named = F.try_element_at(F.create_map(*(F.lit(x) for pair in _NAMES.items() for x in pair)), F.col("lang"))
    allowed = B.pools(wanted, B.attribute_bits(catalog(spark, d), index, {c: F.col(c) for c in _ATTRIBUTES} | {"lang": named}))
    n = queries.agg(F.count(F.lit(1)).alias("n"))
    found = lexical.bm25_search(queries, index, 10, allowed).join(gold(spark, d), ["qid", "doc_id"], "left_semi").agg(F.count_distinct("qid").alias("found"))
    sizes = B.pool_sizes(queries, allowed, index).agg(F.avg("n").alias("avg_pool"))
    return found.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(sizes)).select(F.lit("parser").alias("variant"), F.round("avg_pool", 4).alias("avg_pool"), F.round(F.col("found") / F.col("n"), 6).alias("hit_rate"))


def constraints(spark, d) -> DataFrame:
    """qid, c: search constraints that vary with the item's id; every third item has none."""
    c = (
        "named_struct('weekday_include', array(), 'weekday_exclude', array(), 'hour_min', null, 'hour_max', null, 'hour_exclude_ranges', array(), 'lang_include', if(qid % 3 = 1, array('en'), array()),"
        " 'lang_exclude', if(qid % 3 = 2, array('fr', 'de'), array()), 'kind_include', array(), 'kind_exclude', array(), 'point_min', null, 'point_max', null, 'unit_include', array(), 'unit_exclude', if(qid % 3 = 1, array('src7'), array()), 'residual', '')"
    )
    return items(spark, d).select("qid", F.expr(c).cast(CONSTRAINTS).alias("c"))


def smart_filter(spark, d):
    """A filter of hits that asks only the queries that have constraints; nothing is refilled."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("source").alias("unit"))

    def run(hits: DataFrame) -> DataFrame:
        both = hits.join(small(constraints(spark, d)), "qid", "left").join(docs, "doc_id")
        none = F.array().cast("array<struct<weekday:int,start_hour:int,end_hour:int>>")
        ok = P.passes(none, F.col("lang"), F.lit(None).cast("int"), F.lit(None).cast("double"), F.col("unit"), F.col("c"))
        return both.where(~F.coalesce(P.has_constraints(F.col("c")), F.lit(False)) | ok).select(*hits.columns)

    return run


@query(
    "smart_post_filter",
    _BASE + _leg("l1", "q1") + "SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank FROM l1 JOIN documents USING (doc_id) WHERE CASE qid % 3 WHEN 1 THEN lang = 'en' AND NOT contains(source, 'src7') WHEN 2 THEN lang NOT IN ('fr', 'de') ELSE true END",
)
def smart_post_filter(spark, d):
    return SearchPlan(index_of(spark, d), retrieve_k=K, top_k=K, post_filter=smart_filter(spark, d)).run(items(spark, d), table(spark, d, "documents")).select("qid", "doc_id", "rank")


@query(
    "search_pipeline",
    _BASE + _leg("l1", "q1") + r""",
rp AS (SELECT qid, doc_id, rank AS before, list_distinct(regexp_extract_all(q1.text, '[\p{L}\p{N}_]+')) AS w, list_distinct(regexp_extract_all(d.text, '[\p{L}\p{N}_]+')) AS t FROM l1 JOIN q1 USING (qid) JOIN documents d USING (doc_id)),
rs AS (SELECT qid, doc_id, before, coalesce(len(list_intersect(w, t)) / nullif(len(w), 0), 0.0) AS score FROM rp),
rr AS (SELECT qid, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, before) AS rank FROM rs) WHERE rank <= 10),
pf AS (SELECT qid, doc_id, rank FROM rr JOIN documents USING (doc_id) WHERE CASE qid % 3 WHEN 1 THEN lang = 'en' AND NOT contains(source, 'src7') WHEN 2 THEN lang NOT IN ('fr', 'de') ELSE true END)
""" + _metrics_sql("pf", "(5), (10)") + "SELECT k, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM pf_m GROUP BY k",
)
def search_pipeline(spark, d):
    """Retrieval, re-ranking cut to 10, smart filter, metrics."""
    plan = SearchPlan(index_of(spark, d), retrieve_k=K, top_k=10, scorer=rank.overlap_score, post_filter=smart_filter(spark, d))
    hits = plan.run(items(spark, d), table(spark, d, "documents"))
    return rounded(metrics.macro(metrics.per_query(items(spark, d), hits, gold(spark, d), (5, 10))), "recall", "hit", "mrr", "ndcg", places=6)


@query("subset_filters", "SELECT * FROM (SELECT item_id AS qid FROM benchmark WHERE item_id % 4 = 2 OR item_id % 8 = 1) ORDER BY qid")
def subset_filters(spark, d):
    """Only the queries with a negated condition."""
    return conditions(spark, d).where(P.has_conditions(F.col("must_not"))).select("qid")


@query("sampling_pool", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE coalesce(lang, '') <> '' AND coalesce(source, '') <> '' AND quality IS NOT NULL")
def sampling_pool(spark, d):
    """Documents that have a value in every dimension that a condition needs."""
    return catalog(spark, d).where("coalesce(lang, '') <> '' and coalesce(unit, '') <> '' and kind is not null").select("doc_id")
