"""Catalog records, documents built from them, text functions, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..operators import predicates as P
from ..operators.keywords import Keywords
from ..session import scratch_path
from ..sources import keyed as K
from ..sources import tables as S
from ..sources.layout import in_folders_of, write_catalog
from . import query, table


# ---- scans and keys --------------------------------------------------------------------------------------------


@query("scan_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def scan_filter(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice")


@query("catalog_scan", "SELECT doc_id, lang, '114' AS y, CAST(doc_id % 2 + 1 AS VARCHAR) AS s FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 1")
def catalog_scan(spark, d):
    """One semester of a catalog table of several."""
    path = scratch_path(spark, "catalog")
    rows = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, "114").otherwise("113").alias("y"), (F.col("doc_id") % 2 + 1).cast("string").alias("s"))
    S.write_parquet(rows, path)
    return S.read_catalog(spark, path, "114", "2")


@query("count_rows", "SELECT count(*) AS n FROM lineitem")
def count_rows(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_projection", "SELECT DISTINCT user_id, event_type FROM events WHERE event_type IS NOT NULL AND event_type <> ''")
def distinct_projection(spark, d):
    return table(spark, d, "events").where("event_type is not null and event_type <> ''").select("user_id", "event_type").distinct()


@query("json_decode", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_decode(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(
    "json_text_lists",
    "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || ',' || c_mktsegment WHEN 3 THEN c_mktsegment ELSE '' END AS items FROM customer",
)
def json_text_lists(spark, d):
    """Lists in JSON that customers make of their names: whole, absent, broken, and with items of other types."""
    text = F.expr("""case c_custkey % 4 when 0 then concat('["', c_name, '", "', c_mktsegment, '"]') when 1 then null when 2 then concat('broken [', c_name) else concat('["', c_mktsegment, '", ', c_nationkey, ', null]') end""")
    return table(spark, d, "customer").select("c_custkey", F.array_join(S.json_strings(text), ",").alias("items"))


@query("existing_ids", "SELECT doc_id FROM labels")
def existing_ids(spark, d):
    return table(spark, d, "labels").select("doc_id")


@query("todo_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def todo_anti_join(spark, d):
    return S.not_done(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("gold_lookup_join", "SELECT l_orderkey, l_linenumber, o_orderpriority, o_orderkey IS NOT NULL AS found FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') o ON l_orderkey = o_orderkey")
def gold_lookup_join(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", F.lit(True).alias("found"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(orders, "l_orderkey", "left").fillna({"found": False}).select("l_orderkey", "l_linenumber", "o_orderpriority", "found")


@query("id_map_join", "SELECT user_id, coalesce(c_name, 'unknown') AS name, count(*) AS n FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY ALL")
def id_map_join(spark, d):
    per_user = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return per_user.join(names, "user_id", "left").fillna({"name": "unknown"}).select("user_id", "name", "n")


@query(
    "gold_normalise",
    "SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 3 = 0 THEN list_distinct([o_orderstatus, 'P']) WHEN o_orderkey % 5 = 0 THEN [NULL] ELSE [o_orderpriority] END) AS gold FROM orders",
)
def gold_normalise(spark, d):
    """A list with repeats, an empty one or none, and a single value that may be null."""
    gold = F.expr("case o_orderkey % 3 when 0 then array(o_orderstatus, 'P', o_orderstatus) when 1 then array() end").cast("array<string>")
    single = F.expr("if(o_orderkey % 5 = 0, null, o_orderpriority)")
    return table(spark, d, "orders").select("o_orderkey", F.explode(S.gold_of(gold, single)).alias("gold"))


@query("upsert_latest", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -o_orderkey - 1, 'new' FROM orders WHERE o_orderkey % 3 = 0")
def upsert_latest(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    changed = old.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("status"))
    return S.latest_by_key(old, changed.unionByName(changed.select((-F.col("o_orderkey") - 1).alias("o_orderkey"), "status")), "o_orderkey")


@query("insert_if_absent", "SELECT p_partkey, 'old' AS origin FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'new' FROM part WHERE p_partkey % 2 <> 0")
def insert_if_absent(spark, d):
    part = table(spark, d, "part").select("p_partkey")
    return S.insert_absent(part.where("p_partkey % 2 = 0").withColumn("origin", F.lit("old")), part.withColumn("origin", F.lit("new")), "p_partkey")


@query(
    "stored_upsert",
    "SELECT o_orderkey, o_totalprice AS price, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 5 = 0"
    " UNION ALL SELECT -o_orderkey - 1, o_totalprice, 'late' FROM orders WHERE o_orderkey % 5 = 0",
)
def stored_upsert(spark, d):
    """Orders in a keyed table: some are removed, and then one batch brings some of these back, changes others and adds new ones."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    some = orders.where("o_orderkey % 5 = 0")
    batch = some.withColumn("status", F.lit("new")).unionByName(some.select((-F.col("o_orderkey") - 1).alias("o_orderkey"), "price", F.lit("late").alias("status")))
    stored_orders = K.create(orders, scratch_path(spark, "orders"), "o_orderkey", buckets=16)
    return stored_orders.delete(orders.where("o_orderkey % 7 = 0")).upsert(batch).rows()


@query("stored_insert", "SELECT p_partkey, p_size, CASE WHEN p_size <= 25 THEN 'old' ELSE 'new' END AS origin FROM part")
def stored_insert(spark, d):
    """Parts in a keyed table, of which a second batch brings all: only those that aren't there go in."""
    part = table(spark, d, "part").select("p_partkey", "p_size")
    first = K.create(part.where("p_size <= 25").withColumn("origin", F.lit("old")), scratch_path(spark, "part"), "p_partkey", buckets=16)
    return first.insert_absent(part.withColumn("origin", F.lit("new"))).rows()


@query(
    "merge_summaries",
    "WITH n AS (SELECT c_nationkey, sum(c_acctbal) AS score FROM customer WHERE c_nationkey >= 10 GROUP BY ALL), o AS (SELECT s_nationkey, sum(s_acctbal) AS score FROM supplier WHERE s_nationkey < 15 GROUP BY ALL)"
    " SELECT c_nationkey AS nation, round(score, 2) AS score FROM n UNION ALL SELECT s_nationkey, round(score, 2) FROM o WHERE s_nationkey NOT IN (SELECT c_nationkey FROM n)",
)
def merge_summaries(spark, d):
    """Summaries of suppliers' nations, some of which those of customers' nations replace."""
    old = table(spark, d, "supplier").where("s_nationkey < 15").groupBy(F.col("s_nationkey").alias("nation")).agg(F.round(F.sum("s_acctbal"), 2).alias("score"))
    new = table(spark, d, "customer").where("c_nationkey >= 10").groupBy(F.col("c_nationkey").alias("nation")).agg(F.round(F.sum("c_acctbal"), 2).alias("score"))
    return S.latest_by_key(old, new, "nation")


@query("sink_roundtrip_parquet", "SELECT doc_id, lang, source, n_chars FROM documents")
def sink_roundtrip_parquet(spark, d):
    path = scratch_path(spark, "documents")
    S.write_parquet(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), path)
    return spark.read.parquet(path)


@query("sink_roundtrip_jsonl", "SELECT doc_id, text FROM documents")
def sink_roundtrip_jsonl(spark, d):
    path = scratch_path(spark, "documents")
    S.write_json_lines(table(spark, d, "documents").select("doc_id", "text"), path)
    return S.read_json_lines(spark, path, "doc_id long, text string")


@query("jsonl_dropmalformed", "SELECT item_id AS id, text FROM benchmark WHERE item_id % 2 = 0")
def jsonl_dropmalformed(spark, d):
    """Every second line is broken, and blank lines stand between."""
    path = scratch_path(spark, "lines")
    whole = F.to_json(F.struct(F.col("item_id").alias("id"), "text"))
    lines = table(spark, d, "benchmark").select(F.explode(F.array(F.when(F.col("item_id") % 2 == 0, whole).otherwise(F.concat(F.lit("{"), whole)), F.lit(""))))
    lines.write.text(path)
    return S.read_json_lines(spark, path, "id long, text string", drop_malformed=True)


# ---- records and documents -------------------------------------------------------------------------------------


@query("dedupe_crosslist", "SELECT l_orderkey AS order_id, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey, l_quantity)) AS partkey, arg_min(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_quantity)) AS quantity, string_agg(l_suppkey || '/' || l_returnflag || '/' || l_linestatus, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS cross_listed FROM lineitem GROUP BY l_orderkey")
def dedupe_crosslist(spark, d):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus").alias("ord")
    lines = table(spark, d, "lineitem").select("l_orderkey", order, "l_partkey", "l_quantity", "l_suppkey", "l_returnflag", "l_linestatus")
    out = C.dedupe_crosslisted(lines, "l_orderkey", "ord", ["l_suppkey", "l_returnflag", "l_linestatus"])
    text = F.array_join(F.transform("cross_listed", lambda x: F.concat_ws("/", x["l_suppkey"], x["l_returnflag"], x["l_linestatus"])), ",")
    return out.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("partkey"), F.col("l_quantity").alias("quantity"), text.alias("cross_listed"))


@query("flatten_records", r"SELECT doc_id, length(text) AS text_len, length(coalesce(lang, '')) AS lang_len, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS n_words FROM documents")
def flatten_records(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", "lang", T.tokens(F.col("text")).alias("words"))
    return C.flatten_records(rows, ["text", "lang"], ["words"]).select("doc_id", "text_len", "lang_len", "n_words")


_COURSES = """
WITH k AS (SELECT DISTINCT user_id, isodow(ts) AS w, hour(ts) AS a, hour(ts) + 1 AS b FROM events WHERE event_type = 'click'),
s AS (SELECT user_id, string_agg('星期' || substr('一二三四五六日', CAST(w AS INTEGER), 1) || ' ' || a || ':00-' || b || ':00', '、' ORDER BY w, a) AS t FROM k GROUP BY user_id),
c AS (SELECT d.doc_id, 'name ' || d.doc_id AS name, d.source AS teacher, d.source AS unit, d.lang, coalesce(l.quality, 0) + 1 AS kind, l.toxic, l.doc_id IS NOT NULL AS known, coalesce(t, '未定') AS st, trim(d.text, ' ' || chr(9) || chr(10) || chr(13)) AS objective
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN s ON s.user_id = d.doc_id)
"""


def courses(spark, d) -> DataFrame:
    """Documents in the role of courses: sessions from the clicks of the user with their id, kind from labels."""
    hour = F.hour("ts")
    session = F.struct((F.weekday("ts") + 1).alias("weekday"), hour.alias("start_hour"), (hour + 1).alias("end_hour"))
    sessions = table(spark, d, "events").where("event_type = 'click'").groupBy(F.col("user_id").alias("doc_id")).agg(F.array_sort(F.collect_set(session)).alias("sessions"))
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source").join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left").join(sessions, "doc_id", "left")
    return docs.select(
        F.col("doc_id").cast("string").alias("course_id"), F.concat(F.lit("name "), "doc_id").alias("name"), F.col("source").alias("teacher"), F.col("source").alias("unit"), "lang",
        (F.coalesce("quality", F.lit(0)) + 1).alias("kind"), F.when(F.col("toxic") == 1, "限").otherwise("").alias("lmt_kind"), F.coalesce("toxic", F.lit(0)).alias("core"),
        F.lit(3.0).alias("point"), F.lit("").alias("time_raw"), "sessions", F.col("text").alias("objective"), F.array().cast("array<string>").alias("weekly_topics"),
    )


@query("doc_base", _COURSES + "SELECT CAST(doc_id AS VARCHAR) AS course_id, '課程名稱是' || name || ', 上課時間是' || st || ', 這堂課的老師是' || teacher AS text FROM c")
def doc_base(spark, d):
    return C.BUILDERS["d-base"](courses(spark, d)).select("course_id", "text")


_OBJ = "'課名: ' || name || chr(10) || '教師: ' || teacher || chr(10) || "


@query("doc_obj", _COURSES + "SELECT CAST(doc_id AS VARCHAR) AS course_id, " + _OBJ + "'開課單位: ' || unit || chr(10) || '語言: ' || lang || '　學分: 3.0' || chr(10) || '上課時間: ' || st || chr(10) || '課程目標: ' || substr(objective, 1, 600) AS text FROM c")
def doc_obj(spark, d):
    return C.BUILDERS["d-obj"](courses(spark, d)).select("course_id", "text")


@query(
    "doc_v2",
    _COURSES + "SELECT CAST(doc_id AS VARCHAR) AS course_id, " + _OBJ + """'開課單位: ' || unit || '　語言: ' || lang || '　學分: 3.0' || chr(10) || '課程類別: ' || CASE kind WHEN 1 THEN '必修課' ELSE '選修課' END || CASE WHEN toxic = 1 THEN '（限）' ELSE '' END || chr(10)
  || CASE WHEN coalesce(toxic, 0) <> 0 THEN '核心通識: 是' || chr(10) ELSE '' END || '上課時間: ' || st
  || CASE WHEN known THEN chr(10) || '主題標籤: ' || lang || '、' || unit || chr(10) || '摘要: ' || 's' || doc_id ELSE '' END
  || CASE WHEN objective <> '' THEN chr(10) || '課程目標: ' || substr(objective, 1, 400) ELSE '' END AS text, known AS meta_v1_present FROM c""",
)
def doc_v2(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id")
    known = docs.select(F.col("doc_id").cast("string").alias("course_id"), F.concat(F.lit("s"), "doc_id").alias("summary"), F.array().cast("array<string>").alias("keywords"), F.array("lang", "source").alias("topic_tags"))
    return C.BUILDERS["d-v2"](courses(spark, d), known).select("course_id", "text", "meta_v1_present")


@query("doc_metadata", _COURSES + "SELECT CAST(doc_id AS VARCHAR) AS course_id, unit, lang, kind FROM c")
def doc_metadata(spark, d):
    return C.BUILDERS["d-base"](courses(spark, d)).select("course_id", "metadata.unit", "metadata.lang", "metadata.kind")


@query("prompt_render", "SELECT doc_id, '課名：' || source || chr(10) || '標籤：' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE '（無）' END || chr(10) || '內容：' || substr(text, 1, 500) AS prompt FROM documents")
def prompt_render(spark, d):
    tags = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("")
    return table(spark, d, "documents").select("doc_id", C.prompt(F.col("source"), tags, F.col("text")).alias("prompt"))


@query("request_envelope", "SELECT item_id, 'q-' || item_id AS custom_id, 'm1' AS model, text AS content FROM benchmark")
def request_envelope(spark, d):
    """Requests as JSON, read back by their paths."""
    rows = table(spark, d, "benchmark").select("item_id", C.request_envelope(F.concat(F.lit("q-"), "item_id"), "m1", F.col("text")).alias("j"))
    path = lambda p: F.get_json_object("j", p)
    return rows.select("item_id", path("$.custom_id").alias("custom_id"), path("$.body.model").alias("model"), path("$.body.messages[0].content").alias("content"))


# ---- layout ----------------------------------------------------------------------------------------------------


_terms: dict[tuple[str, str], DataFrame] = {}


def orders_by_term(spark, d) -> DataFrame:
    """The orders as a catalog by year and quarter, sorted by priority; the first query of an application that asks for it writes it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _terms:
        rows = table(spark, d, "orders").withColumn("y", F.year("o_orderdate")).withColumn("s", F.quarter("o_orderdate"))
        _terms[key] = write_catalog(rows, scratch_path(spark, "orders"), "o_orderkey", order=("o_orderpriority", "o_orderstatus"))
    return _terms[key]


@query(
    "catalog_pushed",
    "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE year(o_orderdate) = 1996 AND quarter(o_orderdate) = 2 AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AND NOT (o_orderstatus IN ('F')) AND NOT (o_orderpriority LIKE '%LOW%')",
)
def catalog_pushed(spark, d):
    """Known conditions as predicates of the scan: folders by term, lists and words inside."""
    doc = {"lang": F.col("o_orderpriority"), "lmt_kind": F.col("o_orderstatus"), "unit": F.col("o_orderpriority")}
    wanted = P.literal_matches(doc, {"course_lang": ["1-URGENT", "2-HIGH", "5-LOW"]}, {"lmt_kind": ["F"], "unit": ["LOW"]})
    return orders_by_term(spark, d).where((F.col("y") == 1996) & (F.col("s") == 2) & wanted).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query(
    "catalog_by_terms",
    "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS s FROM orders WHERE (year(o_orderdate), quarter(o_orderdate)) IN (SELECT (year(l_shipdate), quarter(l_shipdate)) FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-02-01')",
)
def catalog_by_terms(spark, d):
    """A table of wanted terms prunes the catalog's folders while the query runs."""
    wanted = table(spark, d, "lineitem").where("l_shipdate < timestamp '1996-02-01'").select(F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("s"))
    return in_folders_of(orders_by_term(spark, d), wanted, "y", "s").select("o_orderkey", F.col("y").cast("long").alias("y"), F.col("s").cast("long").alias("s"))


# ---- text ------------------------------------------------------------------------------------------------------


@query("strip_entities", r"SELECT page_id, regexp_replace(html, '&[a-zA-Z]+;|&#\d+;', '', 'g') AS html FROM pages")
def strip_entities(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_entities(F.col("html")).alias("html"))


@query("clean_text", r"SELECT page_id, regexp_replace(regexp_replace(html, '&[a-zA-Z]+;|&#\d+;', '', 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages")
def clean_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.clean(F.col("html"), normalise=False).alias("text"))


@query(
    "strip_info_prefix",
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || chr(10) || p_type WHEN 1 THEN p_name ELSE p_name || ' @Note: ' || p_type END AS cleaned FROM part",
)
def strip_info_prefix(spark, d):
    """Markers at the beginning of a line go, within one they stay."""
    raw = F.expr("case p_partkey % 3 when 0 then concat('@備註: ', p_name, '\n＠Information：', p_type) when 1 then concat('＠Note：', p_name) else concat(p_name, ' @Note: ', p_type) end")
    return table(spark, d, "part").select("p_partkey", T.strip_info_prefix(raw).alias("cleaned"))


@query("nfkc_clean")
def nfkc_clean(spark, d):
    return table(spark, d, "pages").select("page_id", T.clean(F.col("html")).alias("text"))


@query("tokenise", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_]+'), ' ') AS words FROM documents")
def tokenise(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("words"))


@query("first_sentence", r"SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[。！？!?\n]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) BETWEEN 8 AND 80)[1] AS sentence FROM documents")
def first_sentence(spark, d):
    return table(spark, d, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("sentence"))


@query("query_key", r"SELECT item_id, lower(regexp_replace(text, '\s+', '', 'g')) AS key FROM benchmark")
def query_key(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.query_key(F.col("text")).alias("key"))


@query("query_id", "SELECT item_id, 'syn-' || substr(md5('bench|topic|' || text), 1, 8) AS qid FROM benchmark")
def query_id(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.query_id("syn-", F.lit("bench"), F.lit("topic"), F.col("text")).alias("qid"))


@query("cache_key", "SELECT item_id, substr(sha256('hyde|m1|' || text), 1, 16) AS key FROM benchmark")
def cache_key(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.cache_key(F.lit("hyde"), F.lit("m1"), F.col("text")).alias("key"))


@query("keyword_flags", "SELECT doc_id, contains(text, ' not ') OR contains(text, ' no ') OR contains(text, ' nicht ') AS has_negation, contains(text, 'with') OR contains(text, 'mit') AS has_constraint FROM documents")
def keyword_flags(spark, d):
    body = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.mentions_any(body, [" not ", " no ", " nicht "]).alias("has_negation"), T.mentions_any(body, ["with", "mit"]).alias("has_constraint"))


@query("pattern_extract", r"SELECT doc_id, (WITH z AS (SELECT list_filter(list_transform(list_concat(regexp_extract_all(text, 'with [^.\n]*'), regexp_extract_all(text, 'mit [^.\n]*')), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) BETWEEN 8 AND 50) AS a) SELECT array_to_string(list_filter(a, lambda v, i: list_position(a, v) = i), '|') FROM z) AS found FROM documents")
def pattern_extract(spark, d):
    found = T.extract_patterns(F.col("text"), [r"with [^.\n]*", r"mit [^.\n]*"])
    return table(spark, d, "documents").select("doc_id", F.array_join(found, "|").alias("found"))


def benchmark_words(spark, d) -> DataFrame:
    """word: the words of five letters or more in the benchmark's items."""
    found = F.explode(F.array_distinct(T.tokens(F.col("text"))))
    return table(spark, d, "benchmark").select(found.alias("word")).where("length(word) >= 5").distinct()


_WORDS = r"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS word FROM benchmark), k AS (SELECT word FROM w WHERE length(word) >= 5)"


@query(
    "keyword_mentions",
    _WORDS + ", h AS (SELECT doc_id, word FROM documents, k WHERE contains(text, word)) SELECT doc_id, count(word) AS n, coalesce(string_agg(word, ',' ORDER BY word), '') AS words FROM documents LEFT JOIN h USING (doc_id) GROUP BY doc_id",
)
def keyword_mentions(spark, d):
    """Which of all benchmark words each document contains, in one pass over its text."""
    found = Keywords(benchmark_words(spark, d)).mentions(F.col("text"))
    return table(spark, d, "documents").select("doc_id", found.alias("found")).select("doc_id", F.size("found").cast("long").alias("n"), F.array_join("found", ",").alias("words"))


@query(
    "keyword_phrases",
    _WORDS + r""", h AS (SELECT doc_id, word, unnest(regexp_extract_all(text, word || '[^.\n]*')) AS phrase FROM documents, k WHERE contains(text, word)),
p AS (SELECT DISTINCT doc_id, regexp_replace(phrase, '^\s+|\s+$', '', 'g') AS phrase FROM h)
SELECT doc_id, count(phrase) AS n, coalesce(string_agg(phrase, '|' ORDER BY phrase), '') AS phrases FROM documents LEFT JOIN (SELECT * FROM p WHERE length(phrase) BETWEEN 8 AND 50) USING (doc_id) GROUP BY doc_id""",
)
def keyword_phrases(spark, d):
    """Phrases that begin with any of the benchmark's words and end with the sentence or line, in one pass over each text."""
    found = F.array_sort(Keywords(benchmark_words(spark, d)).phrases(F.col("text")))
    return table(spark, d, "documents").select("doc_id", found.alias("found")).select("doc_id", F.size("found").cast("long").alias("n"), F.array_join("found", "|").alias("phrases"))


def benchmark_words(spark, d) -> DataFrame:
    """word: the words of five letters or more in the benchmark's items."""
    found = F.explode(F.array_distinct(T.tokens(F.col("text"))))
    return table(spark, d, "benchmark").select(found.alias("word")).where("length(word) >= 5").distinct()


_WORDS = r"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS word FROM benchmark), k AS (SELECT word FROM w WHERE length(word) >= 5)"


@query(
    "keyword_mentions",
    _WORDS + ", h AS (SELECT doc_id, word FROM documents, k WHERE contains(text, word)) SELECT doc_id, count(word) AS n, coalesce(string_agg(word, ',' ORDER BY word), '') AS words FROM documents LEFT JOIN h USING (doc_id) GROUP BY doc_id",
)
def keyword_mentions(spark, d):
    """Which of all benchmark words each document contains, in one pass over its text."""
    found = Keywords(benchmark_words(spark, d)).mentions(F.col("text"))
    return table(spark, d, "documents").select("doc_id", found.alias("found")).select("doc_id", F.size("found").cast("long").alias("n"), F.array_join("found", ",").alias("words"))


@query(
    "keyword_phrases",
    _WORDS + r""", h AS (SELECT doc_id, unnest(regexp_extract_all(text, word || '[^.\n]*')) AS phrase FROM documents, k WHERE contains(text, word)),
p AS (SELECT DISTINCT doc_id, regexp_replace(phrase, '^\s+|\s+$', '', 'g') AS phrase FROM h)
SELECT doc_id, count(phrase) AS n, coalesce(string_agg(phrase, '|' ORDER BY phrase), '') AS phrases FROM documents LEFT JOIN (SELECT * FROM p WHERE length(phrase) BETWEEN 8 AND 50) USING (doc_id) GROUP BY doc_id""",
)
def keyword_phrases(spark, d):
    """Phrases that begin with any of the benchmark's words and end with the sentence or line, in one pass over each text."""
    found = F.array_sort(Keywords(benchmark_words(spark, d)).phrases(F.col("text")))
    return table(spark, d, "documents").select("doc_id", found.alias("found")).select("doc_id", F.size("found").cast("long").alias("n"), F.array_join("found", "|").alias("phrases"))


@query("first_seen_dedupe", r"SELECT min(conv_id * 1000000 + turn) AS first_at, key FROM (SELECT *, lower(regexp_replace(text, '\s+', '', 'g')) AS key FROM conversations WHERE role = 'user') GROUP BY key")
def first_seen_dedupe(spark, d):
    from ..operators.evalsets import first_seen

    rows = table(spark, d, "conversations").where("role = 'user'").withColumn("key", T.query_key(F.col("text"))).withColumn("first_at", F.col("conv_id") * 1000000 + F.col("turn"))
    return first_seen(rows, F.col("key"), "first_at").select("first_at", "key")


#: Two days of a part's week, with two periods of the first and one of the second, by its number.
_WEEK, _HOURS = f"'{T.WEEKDAYS}'", f"'{T.PERIODS}'"


@query(
    "time_slots",
    f"""WITH p AS (SELECT p_partkey, p_partkey % 7 + 1 AS a, p_size % 15 + 1 AS x, (p_partkey + 3) % 7 + 1 AS b, p_size % 5 + 1 AS y FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 10 = 9 THEN '' ELSE a || ':' || (x + 5) || '-' || (x + 7) || ':' || substr({_WEEK}, a, 1) || substr({_HOURS}, x, 2) || ',' || b || ':' || (y + 5) || '-' || (y + 6) || ':' || substr({_WEEK}, b, 1) || substr({_HOURS}, y, 1) END AS sessions FROM p""",
)
def time_slots(spark, d):
    day = lambda n: f"substring({_WEEK}, cast({n} % 7 + 1 as int), 1)"
    raw = F.expr(f"if(p_partkey % 10 = 9, '未定', concat({day('p_partkey')}, substring({_HOURS}, cast(p_size % 15 + 1 as int), 2), if(p_partkey % 2 = 0, '', 'x'), {day('(p_partkey + 3)')}, substring({_HOURS}, cast(p_size % 5 + 1 as int), 1)))")
    one = F.transform(T.time_slots(F.col("raw")), lambda s: F.concat(s["weekday"], F.lit(":"), s["start_hour"], F.lit("-"), s["end_hour"], F.lit(":"), s["raw"]))
    return table(spark, d, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", F.array_join(one, ",").alias("sessions"))


@query(
    "weekly_topics",
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority || ';Overview ' || o_orderstatus WHEN 1 THEN 'Only ' || o_orderpriority ELSE '' END AS topics FROM orders",
)
def weekly_topics(spark, d):
    """Schedules with a blank cell and a repeated topic, without one, with a topic that is too long, and nulls."""
    schedule = F.expr("case o_orderkey % 4 when 0 then concat('Week|Date|Topic|1|', month(o_orderdate), '/27|', o_orderpriority, '|2|3/6| |Overview ', o_orderstatus, '|3|3/13|', o_orderpriority) when 1 then '' when 2 then concat('9/1|', repeat('y', 81), '|9/8') end")
    syllabus = F.expr("if(o_orderkey % 4 = 1, concat('1|9/1|Only ', o_orderpriority, '|x'), if(o_orderkey % 4 = 3, null, ''))")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.weekly_topics(schedule, syllabus), ";").alias("topics"))


@query("first_json_object", "SELECT event_id, CASE WHEN event_id % 4 IN (0, 3) THEN props END AS found FROM events")
def first_json_object(spark, d):
    text = F.expr("case event_id % 4 when 0 then concat('say ', props, ' ok') when 1 then event_type when 2 then concat(props, ' and ', props) else concat('x\n', props) end")
    return table(spark, d, "events").select("event_id", T.first_json_object(text).alias("found"))


@query("list_cleanup", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || '|b|c|d' ELSE '' END AS variants FROM orders")
def list_cleanup(spark, d):
    """Blank variants, the query itself and all after the fourth go."""
    variants = F.expr("if(o_orderkey % 2 = 0, array(concat(' ', o_orderstatus, ' '), '', o_orderpriority, 'b', 'c', 'd', 'e'), array())").cast("array<string>")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.clean_variants(variants, F.col("o_orderpriority")), "|").alias("variants"))


@query("strip_quotes", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN p_brand || chr(39) || p_name ELSE p_name END AS bare FROM part")
def strip_quotes(spark, d):
    raw = F.expr("case p_partkey % 3 when 0 then concat('「', p_name, '」') when 1 then concat('\"', p_brand, char(39), p_name, '\"') else p_name end")
    return table(spark, d, "part").select("p_partkey", T.strip_quotes(raw).alias("bare"))


@query("query_guard", "SELECT item_id, CASE WHEN contains(reverse(text), text) THEN reverse(text) ELSE text || chr(10) || reverse(text) END AS passage FROM benchmark")
def query_guard(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.with_query(F.reverse("text"), F.col("text")).alias("passage"))


@query("ordered_dedupe", "SELECT conv_id, array_to_string(list_transform(list_sort(list({'t': t, 'r': role})), lambda x: x.r), ',') AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) GROUP BY conv_id")
def ordered_dedupe(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("turn"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"))


@query("set_overlap", "SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT vec_id FROM embeddings) UNION ALL SELECT 'documents', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT vec_id FROM embeddings) UNION ALL SELECT 'vectors', count(*) FROM (SELECT vec_id FROM embeddings EXCEPT SELECT doc_id FROM documents)")
def set_overlap(spark, d):
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return count("both", a.intersect(b)).unionByName(count("documents", a.subtract(b))).unionByName(count("vectors", b.subtract(a)))


@query("find_texts", "SELECT doc_id, substr(text, 1, 600) AS head FROM documents WHERE contains(text, 'the') AND contains(text, 'ing') ORDER BY doc_id LIMIT 3")
def find_texts(spark, d):
    """A report: the first three documents with two substrings."""
    return table(spark, d, "documents").where(F.contains("text", F.lit("the")) & F.contains("text", F.lit("ing"))).orderBy("doc_id").limit(3).select("doc_id", F.substring("text", 1, 600).alias("head"))
