"""Conditions made from records, prompts rendered from them, and gold checked against what queries ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsers as N
from ..functions import text as T
from ..operators import catalog as C
from ..operators import evalsets as E
from ..operators import synthesis as Y
from ..schema import CONDITIONS
from . import query, table
from .parsers import dealt, dealt_values


def records(spark, d) -> DataFrame:
    """A catalog with a value in most dimensions, made from the documents' ids."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("unit"))
    lists = {name: "array(" + ", ".join(f"'{x}'" for x in xs) + ")" for name, xs in (("l", Y.LANGUAGES), ("b", Y.BRANCHES))}
    return docs.selectExpr(
        "*", f"if(id % 11 = 0, '', {lists['l']}[cast(id % 6 as int)]) as lang", "filter(sequence(1, 7), w -> (id div w) % 3 = 0) as weekdays",
        "array_compact(array(if(id % 2 = 0, 'morning', null), if(id % 3 = 0, 'noon', null), if(id % 4 = 0, 'afternoon', null), if(id % 5 = 0, 'evening', null))) as parts",
        "cast(1 + id % 5 as double) as point", "cast(id % 6 as int) as kind", f"if(id % 4 = 0, {lists['b']}[cast(id % 7 as int)], '') as lmt_kind",
    )


_DIMENSIONS = {
    "course_lang": "lang <> ''", "weekday": "len(weekdays) > 0", "hour_range": "len(parts) > 0", "point": "point <= 4", "kind": "kind BETWEEN 1 AND 4", "lmt_kind": "lmt_kind <> ''", "unit": "coalesce(unit, '') <> ''",
}
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_HASH = lambda seed: f"CAST('0x' || substr(md5('{seed}|' || stratum || '|' || id), 1, 8) AS BIGINT)"
_PICK = lambda xs, seed: f"({xs})[1 + {_HASH(seed)} % nullif(len({xs}), 0)]"
_HOURS = lambda part: f"CASE {part} WHEN 'morning' THEN '8,12' WHEN 'noon' THEN '12,13' WHEN 'afternoon' THEN '13,18' WHEN 'evening' THEN '18,24' END"
_STRATA = "(VALUES " + ", ".join(f"({i}, {_LIST(m)}::VARCHAR[], {_LIST(no)}::VARCHAR[], {n})" for i, m, no, n in Y.strata()) + ") t(stratum, asks, bars, rows)"
_OTHER_DAYS = "(CASE WHEN len(weekdays) < 7 THEN list_filter(range(1, 8), lambda w: NOT list_contains(weekdays, w)) ELSE weekdays[1:1] END)"
_OTHER_PARTS = "list_filter(['morning', 'noon', 'afternoon', 'evening'], lambda p: NOT list_contains(parts, p))"
_SOME = f"(1 + {_HASH('days')} % least(len(o), 2))"
_KIND = f"{_LIST(Y.KINDS)}[kind]"


@query(
    "synth_strata",
    f"""WITH r AS (
  SELECT doc_id AS id, source AS unit, CASE WHEN doc_id % 11 = 0 THEN '' ELSE {_LIST(Y.LANGUAGES)}[1 + doc_id % 6] END AS lang, list_filter(range(1, 8), lambda w: (doc_id // w) % 3 = 0) AS weekdays,
    list_filter([CASE WHEN doc_id % 2 = 0 THEN 'morning' END, CASE WHEN doc_id % 3 = 0 THEN 'noon' END, CASE WHEN doc_id % 4 = 0 THEN 'afternoon' END, CASE WHEN doc_id % 5 = 0 THEN 'evening' END], lambda p: p IS NOT NULL) AS parts,
    CAST(1 + doc_id % 5 AS DOUBLE) AS point, doc_id % 6 AS kind, CASE WHEN doc_id % 4 = 0 THEN {_LIST(Y.BRANCHES)}[1 + doc_id % 7] ELSE '' END AS lmt_kind FROM documents),
h AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _DIMENSIONS.items())}], lambda x: x IS NOT NULL) AS has FROM r),
c AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || stratum || '|' || id), id) AS nth FROM h, {_STRATA} WHERE list_has_all(has, asks) AND list_has_all(has, bars)),
k AS (SELECT *, {_OTHER_DAYS} AS o FROM c WHERE nth <= rows)
SELECT stratum, id,
  concat_ws(';', CASE WHEN list_contains(asks, 'course_lang') THEN lang END, CASE WHEN list_contains(asks, 'weekday') THEN array_to_string(weekdays[1:1 + {_HASH("own")} % greatest(len(weekdays), 1)], ',') END,
    CASE WHEN list_contains(asks, 'hour_range') THEN {_HOURS(_PICK("parts", "part"))} END, CASE WHEN list_contains(asks, 'point') THEN CAST(point AS VARCHAR) END, CASE WHEN list_contains(asks, 'kind') THEN {_KIND} END,
    CASE WHEN list_contains(asks, 'lmt_kind') THEN lmt_kind END, CASE WHEN list_contains(asks, 'unit') THEN unit END) AS must,
  concat_ws(';', CASE WHEN list_contains(bars, 'course_lang') THEN {_PICK(f"list_filter({_LIST(Y.LANGUAGES)}, lambda x: x <> lang)", "lang")} END,
    CASE WHEN list_contains(bars, 'weekday') THEN array_to_string(o[1 + {_HASH("from")} % (len(o) - {_SOME} + 1):{_HASH("from")} % (len(o) - {_SOME} + 1) + {_SOME}], ',') END,
    CASE WHEN list_contains(bars, 'hour_range') THEN {_HOURS(f"coalesce({_PICK(_OTHER_PARTS, 'hours')}, 'morning')")} END,
    CASE WHEN list_contains(bars, 'point') THEN CAST({_PICK("list_filter([1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE, 4.0::DOUBLE], lambda x: x <> point)", "point")} AS VARCHAR) END,
    CASE WHEN list_contains(bars, 'kind') THEN {_PICK(f"list_filter({_LIST(Y.KINDS)}, lambda x: x <> {_KIND})", "kind")} END,
    CASE WHEN list_contains(bars, 'lmt_kind') THEN {_PICK(f"list_filter({_LIST(Y.BRANCHES)}, lambda x: x <> lmt_kind)", "branch")} END) AS must_not
FROM k""",
)
def synth_strata(spark, d):
    """Conditions in all strata, each side as one text."""

    def side(c: str):
        fields = [F.array_join(f"{c}.course_lang", ","), F.array_join(F.col(f"{c}.weekday").cast("array<string>"), ","), F.array_join(F.col(f"{c}.hour_range").cast("array<string>"), ","), F.col(f"{c}.point").cast("string")]
        return F.concat_ws(";", *fields, *(F.array_join(f"{c}.{n}", ",") for n in ("kind", "lmt_kind", "unit")))

    return Y.synthesise(records(spark, d), Y.strata()).select("stratum", "id", side("must").alias("must"), side("must_not").alias("must_not"))


#: query, then of its gold: known, time, language, unit, points, kind; then the first failing check of the first report and all of the second
CHECKED = (
    (1, "週四下午英文授課的行銷", True, "四56", "英文", "企管系", 3.0, 1, "", ""),
    (2, "週四下午英文授課的行銷", True, "三56", "中文", "企管系", 3.0, 1, "weekday", "lang,weekday"),
    (3, "找早上的程式設計課", True, "一56", "中文", "資管系", 3.0, 2, "hour", "hour"),
    (4, "3 學分以上的法律系課", True, "一34", "中文", "心理系", 2.0, 2, "", "unit"),
    (5, "不要早上的課，找社會通識，3學分", True, "一56", "中文", "社會系", 2.0, 3, "", "point"),
    (6, "經濟系大三必修", False, "", "", "", None, None, "not_in_db", "not_in_db"),
    (7, "10點以後的統計系", True, "未定", "中文", "統計系", 3.0, 1, "", ""),
    (8, "週一到週五的課", True, "六34", None, None, None, None, "weekday", "weekday"),
    (9, "想學經濟學的入門", True, "二78", "英文", "經濟系", 3.0, 1, "", ""),
)


def checked(spark, d) -> DataFrame:
    """The queries of customers, dealt by their numbers, with the gold record that each is checked against."""
    rows = dealt(spark, d, [r[1:8] for r in CHECKED], "query string, known boolean, slot string, lang string, unit string, point double, kind int")
    rows = rows.withColumn("c", N.parse_rules(F.col("query"))).withColumn("sessions", T.time_slots(F.col("slot")))
    bad = E.consistency(*(F.col(n) for n in ("c", "known", "sessions", "lang", "unit", "point", "kind")))
    return rows.select("c_custkey", *(E.inconsistencies({n: bad[n] for n in names}).alias(report) for report, names in (("first", E.FIRST_CHECKS), ("every", E.ALL_CHECKS))))


@query("gold_consistency_parsed", dealt_values([r[8:] for r in CHECKED], "first_reason, reasons"))
def gold_consistency_parsed(spark, d):
    """Gold against the constraints parsed from the query: the first failing check of one report, all of the other."""
    first = F.coalesce(F.try_element_at("first", F.lit(1)), F.lit(""))
    return checked(spark, d).select("c_custkey", first.alias("first_reason"), F.array_join("every", ",").alias("reasons"))


@query("clean_eval_set_parsed", dealt_values([(r[9],) for r in CHECKED], "reasons", "c_custkey") + " WHERE reasons = ''")
def clean_eval_set_parsed(spark, d):
    return checked(spark, d).where(F.size("every") == 0).select("c_custkey")


LINES = (
    (1, "gold課程：統計（資管系）\nmust（必須）：授課語言=['英文', '日文']，星期=星期一、星期三，時段=morning（8:00-12:00），學分=3.0\nmust_not（排除）：不要=星期五，不要時段=9-11點（9:00-11:00）"),
    (2, "gold課程：統計（資管系）\nmust（必須）：課程類型=['必修']，通識類型=['社會通識']，系所=['資管系']"),
    (3, "gold課程：統計（資管系）\nmust_not（排除）：不要授課語言=['中文']，不要學分=2.0，不要課程類型=['選修']，不要通識類型=['人文通識']"),
)
_C = "named_struct('course_lang', {}, 'weekday', {}, 'hour_range', {}, 'point', {}, 'kind', {}, 'lmt_kind', {}, 'unit', {})"


@query("condition_lines", "SELECT c_custkey, replace(text, '統計', c_name) AS text FROM customer JOIN (VALUES " + ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in LINES) + ") t(nth, text) ON nth = c_custkey % 3 + 1")
def condition_lines(spark, d):
    """One of three conditions for each customer, as a record of that name."""
    none = ["null"] * 7
    must = {1: ["array('英文', '日文')", "array(1, 3)", "array(8, 12)", "3.0D", "null", "null", "null"], 2: ["null", "null", "null", "null", "array('必修')", "array('社會通識')", "array('資管系')"], 3: none}
    must_not = {1: ["null", "array(5)", "array(9, 11)", "null", "null", "null", "null"], 2: none, 3: ["array('中文')", "null", "null", "2.0D", "array('選修')", "array('人文通識')", "null"]}
    m, n = (F.element_at(F.array(*(F.expr(_C.format(*c[i])).cast(CONDITIONS) for i in c)), (F.col("c_custkey") % 3 + 1).cast("int")) for c in (must, must_not))
    return table(spark, d, "customer").select("c_custkey", N.condition_lines(F.col("c_name"), F.lit("資管系"), m, n).alias("text"))


_QUERIES = "Record: {name} ({unit})\nlanguage {lang}, points {point}, by {teacher}\n{objective}\n{schedule}\nWrite three queries."
_METADATA = "{name}/{name_en} {kind} {lmt_kind} {lang} {unit} {teacher} {point}\n{objective}\n{schedule}\nTags: {tags}"


@query(
    "prompts_rendered",
    "SELECT doc_id, 'Record: ' || source || ' (u)' || chr(10) || 'language ' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE '—' END || ', points 3, by t' || chr(10) || CASE WHEN text = '' THEN '（無）' ELSE substr(text, 1, 500) END || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'plan' ELSE substr(text, 1, 300) END || chr(10) || 'Write three queries.' AS queries,"
    " source || '/' || lang || ' 1 — ' || lang || ' u t 3' || chr(10) || CASE WHEN text = '' THEN '（無）' ELSE substr(text, 1, 600) END || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'plan' ELSE substr(text, 1, 600) END || chr(10) || 'Tags: a、b' AS metadata FROM documents",
)
def prompts_rendered(spark, d):
    """Both prompts, with their cuts and placeholders."""
    c = {n: F.lit(v) for n, v in {"unit": "u", "teacher": "t", "point": "3", "kind": "1", "lmt_kind": ""}.items()}
    c |= {"name": F.col("source"), "name_en": F.col("lang"), "objective": F.col("text"), "syllabus": F.col("text"), "schedule": F.when(F.col("doc_id") % 3 == 0, "plan").otherwise("")}
    queries = C.render(_QUERIES, C.query_prompt_fields(c | {"lang": F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("")}))
    metadata = C.render(_METADATA, C.metadata_prompt_fields(c | {"lang": F.col("lang")}, ["a", "b"]))
    return table(spark, d, "documents").select("doc_id", queries.alias("queries"), metadata.alias("metadata"))
