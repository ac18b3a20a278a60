"""Parsers over the queries that customers ask, scores of parsed conditions, and text made from conditions.

Each customer asks the query that the customer's number picks from the tables below, with the segment behind; the oracle has the
values expected of each query, worked out by hand from the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsers as N
from ..operators import predicates, slots
from ..schema import CONDITIONS
from . import query, table

#: query: days in, days out, lowest hour, highest hour, hours out, languages in, out, points from, to, units in, out, rest
RULES = {
    "週四下午英文授課的行銷": ("4", "", 13, 18, "", "英文", "", None, None, "", "", "授課的行銷"),
    "找早上的程式設計課": ("", "", 8, 12, "", "", "", None, None, "", "", "找 的程式設計課"),
    "3 學分以上的法律系課": ("", "", None, None, "", "", "", 3.0, None, "法律", "", "的 系課"),
    "想學經濟學的入門": ("", "", None, None, "", "", "", None, None, "", "", "想學經濟學的入門"),
    "經濟系大三必修": ("", "", None, None, "", "", "", None, None, "經濟", "", "系大三"),
    "中文系的課": ("", "", None, None, "", "", "", None, None, "", "", "中文系的課"),
    "不要週一早八的英文授課行銷課": ("", "1", None, None, "8-9", "", "英文", None, None, "", "", "的 授課行銷課"),
    "不要早上的課，找社會通識，3學分": ("", "", None, None, "8-12", "", "", 3.0, 3.0, "", "", "不要 的課，找社會 ，"),
    "週一到週五的課": ("1,2,3,4,5", "", None, None, "", "", "", None, None, "", "", "到 的課"),
    "不想週三到週五": ("", "3,4,5", None, None, "", "", "", None, None, "", "", "到"),
    "星期六至星期二": ("6", "", None, None, "", "", "", None, None, "", "", "至"),
    "早上下午都可以": ("", "", 13, 12, "", "", "", None, None, "", "", "都可以"),
    "10點以後的統計系": ("", "", 10, None, "", "", "", None, None, "統計", "", "以後的 系"),
    "9:00開始的課": ("", "", 9, None, "", "", "", None, None, "", "", "開始的課"),
    "English授課": ("", "", None, None, "", "英文", "", None, None, "", "", "English授課"),
    "二學分以下": ("", "", None, None, "", "", "", None, 2.0, "", "", ""),
    "3.5學分": ("", "", None, None, "", "", "", 5.0, 5.0, "", "", "3."),
    "不要法律系的課，想找心理系": ("", "", None, None, "", "", "", None, None, "心理", "法律", "不要 系的課，想找 系"),
    "商學院的課": ("", "", None, None, "", "", "", None, None, "", "", "商學院的課"),
}
#: query: languages, days, hours, points, kinds, branches, units wanted; and those not wanted (units never)
PATTERNS = {
    "週四下午英文授課的行銷": (("英文", "4", "13,18", None, "", "", ""), ("", "", "", None, "", "")),
    "3 學分以上的法律系課": (("", "", "", 3.0, "", "", "分以上的法律系"), ("", "", "", None, "", "")),
    "經濟系大三必修": (("", "", "", None, "必修", "", "經濟系"), ("", "", "", None, "", "")),
    "中文系的課": (("中文", "", "", None, "", "", "中文系"), ("", "", "", None, "", "")),
    "不要週一早八的英文授課行銷課": (("", "", "", None, "", "", ""), ("英文", "1", "", None, "", "")),
    "不要早上的課，找社會通識，3學分": (("", "", "", 3.0, "", "", ""), ("", "", "8,12", None, "", "社會通識")),
    "不想週三到週五": (("", "", "", None, "", "", ""), ("", "3,4,5", "", None, "", "")),
    "星期六至星期二": (("", "", "", None, "", "", ""), ("", "", "", None, "", "")),
    "早上下午都可以": (("", "", "8,12", None, "", "", ""), ("", "", "", None, "", "")),
    "不要必修，選修體育": (("", "", "", None, "", "", ""), ("", "", "", None, "必修,選修,體育", "")),
    "一到三的資訊管理系": (("", "1,2,3", "", None, "", "", "三的資訊管理系"), ("", "", "", None, "", "")),
    "9點到12點的課": (("", "", "9,12", None, "", "", ""), ("", "", "", None, "", "")),
    "排除日文的晚上課": (("", "", "", None, "", "", ""), ("日文", "", "18,24", None, "", "")),
    "商學院的課": (("", "", "", None, "", "", "商學院"), ("", "", "", None, "", "")),
}


def _value(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(rows, names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) AS t({names})"


def frame(spark, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def joined(c):
    return F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(""))


#: Tasks at least that customers are spread over: their rows are a few bytes in a file of few splits, but parsing one takes a fraction of a millisecond.
TASKS = 64


def dealt(spark, d, rows, schema: str) -> DataFrame:
    """Each customer with the row that its number picks: c_custkey, c_mktsegment and the row's columns; spread over many tasks."""
    nth = (F.col("c_custkey") % len(rows)).cast("int").alias("nth")
    cases = frame(spark, [(i, *r) for i, r in enumerate(rows)], f"nth int, {schema}")
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment", nth).repartition(max(TASKS, 3 * spark.sparkContext.defaultParallelism), "c_custkey")
    return customers.join(F.broadcast(cases), "nth").drop("nth")


def dealt_values(rows, names: str, columns: str | None = None) -> str:
    """The same in SQL; ``columns`` says what to select, c_custkey and the row's columns by default."""
    return f"SELECT {columns or 'c_custkey, ' + names} FROM customer JOIN (VALUES {', '.join('(' + ', '.join(map(_value, (i, *r))) + ')' for i, r in enumerate(rows))}) AS t(nth, {names}) ON nth = c_custkey % {len(rows)}"


def _asked(spark, d, queries) -> DataFrame:
    """c_custkey and q, a query with the customer's segment behind."""
    return dealt(spark, d, [(q,) for q in queries], "said string").select("c_custkey", F.concat_ws(" ", "said", "c_mktsegment").alias("q"))


def _expected(rows, names: str) -> str:
    rest = names.split(", ", 1)[1]
    return dealt_values(rows, "said, " + rest, f"c_custkey, said || ' ' || c_mktsegment AS q, {rest.replace('residual', "ltrim(residual || ' ' || c_mktsegment) AS residual").replace('expanded', "replace(expanded, said, said || ' ' || c_mktsegment) AS expanded")}")


def _rule_queries(spark, d) -> DataFrame:
    return _asked(spark, d, RULES)


@query("parse_rule_weekday", _expected([(q, r[0], r[1]) for q, r in RULES.items()], "q, days_in, days_out"))
def parse_rule_weekday(spark, d):
    yes, no = N.rule_weekdays(F.col("q"))
    return _rule_queries(spark, d).select("c_custkey", "q", joined(yes).alias("days_in"), joined(no).alias("days_out"))


@query("parse_rule_bucket", _expected([(q, r[3], r[4]) for q, r in RULES.items()], "q, hour_max, hours_out"))
def parse_rule_bucket(spark, d):
    _, high, out = N.rule_hours(F.col("q"))
    text = F.array_join(F.transform(out, lambda x: F.concat(x["low"], F.lit("-"), x["high"])), ",")
    return _rule_queries(spark, d).select("c_custkey", "q", high.alias("hour_max"), text.alias("hours_out"))


@query("parse_rule_hour", _expected([(q, r[2]) for q, r in RULES.items()], "q, hour_min"))
def parse_rule_hour(spark, d):
    return _rule_queries(spark, d).select("c_custkey", "q", N.rule_hours(F.col("q"))[0].alias("hour_min"))


@query("parse_rule_lang", _expected([(q, r[5], r[6]) for q, r in RULES.items()], "q, langs_in, langs_out"))
def parse_rule_lang(spark, d):
    yes, no = N.rule_languages(F.col("q"))
    return _rule_queries(spark, d).select("c_custkey", "q", joined(yes).alias("langs_in"), joined(no).alias("langs_out"))


@query("parse_rule_point", _expected([(q, r[7], r[8]) for q, r in RULES.items()], "q, point_min, point_max"))
def parse_rule_point(spark, d):
    low, high = N.rule_points(F.col("q"))
    return _rule_queries(spark, d).select("c_custkey", "q", low.alias("point_min"), high.alias("point_max"))


@query("parse_rule_unit", _expected([(q, r[9], r[10]) for q, r in RULES.items()], "q, units_in, units_out"))
def parse_rule_unit(spark, d):
    yes, no = N.rule_units(F.col("q"))
    return _rule_queries(spark, d).select("c_custkey", "q", joined(yes).alias("units_in"), joined(no).alias("units_out"))


@query("parse_rule_residual", _expected([(q, r[11]) for q, r in RULES.items()], "q, residual"))
def parse_rule_residual(spark, d):
    return _rule_queries(spark, d).select("c_custkey", "q", N.parse_rules(F.col("q"))["residual"].alias("residual"))


_FULL = "q, days_in, days_out, hour_min, hour_max, hours_out, langs_in, langs_out, point_min, point_max, units_in, units_out, residual"


@query("parse_rule_full", _expected([(q, *r) for q, r in RULES.items()], _FULL))
def parse_rule_full(spark, d):
    c = _rule_queries(spark, d).select("c_custkey", "q", N.parse_rules(F.col("q")).alias("c")).select("c_custkey", "q", "c.*")
    ranges = F.array_join(F.transform("hour_exclude_ranges", lambda x: F.concat(x["low"], F.lit("-"), x["high"])), ",")
    return c.select(
        "c_custkey", "q", joined(F.col("weekday_include")).alias("days_in"), joined(F.col("weekday_exclude")).alias("days_out"), "hour_min", "hour_max", ranges.alias("hours_out"),
        joined(F.col("lang_include")).alias("langs_in"), joined(F.col("lang_exclude")).alias("langs_out"), "point_min", "point_max",
        joined(F.col("unit_include")).alias("units_in"), joined(F.col("unit_exclude")).alias("units_out"), "residual",
    )


@query("has_constraints", _expected([(q, any(x not in ("", None) for x in r[:11])) for q, r in RULES.items()], "q, has_any"))
def has_constraints(spark, d):
    return _rule_queries(spark, d).select("c_custkey", "q", predicates.has_constraints(N.parse_rules(F.col("q"))).alias("has_any"))


def _adapted(r):
    hours = "" if r[2] is None and r[3] is None else f"{r[2] or 0},{24 if r[3] is None else r[3]}"
    return r[5], r[0], hours, r[7] if r[7] is not None else r[8], r[9], r[6], r[1], r[4].split(";")[0].replace("-", ",")


@query("adapt_rule", _expected([(q, *_adapted(r)) for q, r in RULES.items()], "q, lang, days, hours, point, units, not_lang, not_days, not_hours"))
def adapt_rule(spark, d):
    c = _rule_queries(spark, d).select("c_custkey", "q", N.parse_rules(F.col("q")).alias("c"))
    must, must_not = N.adapt(F.col("c"))
    both = c.select("c_custkey", "q", must.alias("m"), must_not.alias("n"))
    return both.select(
        "c_custkey", "q", joined(F.col("m.course_lang")).alias("lang"), joined(F.col("m.weekday")).alias("days"), joined(F.col("m.hour_range")).alias("hours"), F.col("m.point").alias("point"),
        joined(F.col("m.unit")).alias("units"), joined(F.col("n.course_lang")).alias("not_lang"), joined(F.col("n.weekday")).alias("not_days"), joined(F.col("n.hour_range")).alias("not_hours"),
    )


def _pattern_queries(spark, d) -> DataFrame:
    return _asked(spark, d, PATTERNS)


def _pattern_query(name: str, place: int, function):
    @query(f"parse_regex_{name}", _expected([(q, m[place], n[place] if place < 6 else "") for q, (m, n) in PATTERNS.items()], "q, wanted, unwanted"))
    def run(spark, d):
        found = function(F.col("q"))
        yes, no = found if isinstance(found, tuple) else (found, None)
        if place == 3:
            return _pattern_queries(spark, d).select("c_custkey", "q", yes.alias("wanted"), no.alias("unwanted"))
        return _pattern_queries(spark, d).select("c_custkey", "q", joined(yes).alias("wanted"), (F.lit("") if no is None else joined(no)).alias("unwanted"))


for _i, (_n, _f) in enumerate(
    (("lang", N.pattern_languages), ("weekday", N.pattern_weekdays), ("hour", N.pattern_hours), ("point", N.pattern_points), ("kind", N.pattern_kinds), ("lmt", N.pattern_branches), ("unit", N.pattern_units))
):
    _pattern_query(_n, _i, _f)

_SIDE = "lang, days, hours, point, kinds, branches"


def _flat(c: str, prefix: str, units: bool):
    cols = [joined(F.col(f"{c}.course_lang")).alias(prefix + "lang"), joined(F.col(f"{c}.weekday")).alias(prefix + "days"), joined(F.col(f"{c}.hour_range")).alias(prefix + "hours"), F.col(f"{c}.point").alias(prefix + "point"), joined(F.col(f"{c}.kind")).alias(prefix + "kinds"), joined(F.col(f"{c}.lmt_kind")).alias(prefix + "branches")]
    return cols + ([joined(F.col(f"{c}.unit")).alias(prefix + "units")] if units else [])


@query("parse_regex_full", _expected([(q, *m, *n) for q, (m, n) in PATTERNS.items()], f"q, {_SIDE}, units, " + ", ".join("not_" + x.strip() for x in _SIDE.split(","))))
def parse_regex_full(spark, d):
    must, must_not = N.parse_patterns(F.col("q"))
    return _pattern_queries(spark, d).select("c_custkey", "q", must.alias("m"), must_not.alias("n")).select("c_custkey", "q", *_flat("m", "", True), *_flat("n", "not_", False))


RESPONSES = {
    1: ('好的：{"must": {"course_lang": ["英文"], "point": 3}, "must_not": {"weekday": [1, 5]}} 完成', "英文", 3.0, "1,5"),
    2: ('{"must": {}, "must_not": {}}', "", None, ""),
    3: ("no json here", "", None, ""),
    4: ('{"must": {"course_lang": ["日文"', "", None, ""),
    5: (None, "", None, ""),
}


@query("decode_llm_conditions", dealt_values([r[1:] for r in RESPONSES.values()], "lang, point, not_days"))
def decode_llm_conditions(spark, d):
    rows = dealt(spark, d, [r[:1] for r in RESPONSES.values()], "response string")
    must, must_not = N.decode_conditions(F.col("response"))
    both = rows.select("c_custkey", must.alias("m"), must_not.alias("n"))
    return both.select("c_custkey", joined(F.col("m.course_lang")).alias("lang"), F.col("m.point").alias("point"), joined(F.col("n.weekday")).alias("not_days"))


EXPANDED = {
    "週四下午英文授課的行銷": "週四下午英文授課的行銷 星期四 13:00 15:00 18:00 英文",
    "找早上的程式設計課": "找早上的程式設計課 08:00 10:00 12:00",
    "經濟系大三必修": "經濟系大三必修 經濟系",
    "週一到週五的課": "週一到週五的課",
    "9:00開始的課": "9:00開始的課 09:00",
    "想學經濟學的入門": "想學經濟學的入門",
}


@query("bm25_expand_constraints", _expected(list(EXPANDED.items()), "q, expanded"))
def bm25_expand_constraints(spark, d):
    rows = _asked(spark, d, EXPANDED).select("c_custkey", "q", N.parse_rules(F.col("q")).alias("c"))
    return rows.select("c_custkey", "q", N.expand_query(F.col("q"), F.col("c")).alias("expanded"))


@query(
    "condition_prose",
    "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '語言=英文/' || c_mktsegment || '；星期=1/' || (c_nationkey % 5 + 2) || '；學分=' || (c_nationkey % 4 + 1) || '.0；不要時段=8/12' WHEN 1 THEN '' ELSE '不要類別=必修' END AS prose FROM customer",
)
def condition_prose(spark, d):
    """Conditions that customers make of their segment and nation."""
    c = "named_struct('course_lang', {}, 'weekday', {}, 'hour_range', {}, 'point', {}, 'kind', {}, 'lmt_kind', null, 'unit', null)"
    none = c.format(*["null"] * 5)
    must = F.expr(f"case c_custkey % 3 when 0 then {c.format("array('英文', c_mktsegment)", 'array(1, cast(c_nationkey % 5 + 2 as int))', 'null', 'cast(c_nationkey % 4 + 1 as double)', 'null')} else {none} end").cast(CONDITIONS)
    must_not = F.expr(f"case c_custkey % 3 when 0 then {c.format('null', 'null', 'array(8, 12)', 'null', 'null')} when 2 then {c.format('null', 'null', 'null', 'null', "array('必修')")} else {none} end").cast(CONDITIONS)
    both = table(spark, d, "customer").select("c_custkey", must.alias("m"), must_not.alias("n"))
    return both.select("c_custkey", N.condition_prose(F.col("m"), F.col("n")).alias("prose"))


# ---- scores of conditions that orders predict against those that they have ------------------------------------

#: has_negation, complexity, then predicted and wanted JSON of must and must_not, as SQL on orders for both engines.
SCORED = (
    'o_orderkey AS id',
    'o_orderkey % 4 IN (1, 2) AS has_negation',
    "CASE WHEN o_orderkey % 4 IN (0, 3) THEN 'single' ELSE 'multi' END AS complexity",
    """CASE o_orderkey % 4 WHEN 0 THEN concat('{"weekday":[', o_custkey % 5 + 1, ',', o_custkey % 5 + 2, ']}') WHEN 1 THEN '{"course_lang":["英文"],"hour_range":[12,8]}' WHEN 2 THEN concat('{"point":', o_custkey % 3, '}') ELSE '{}' END AS pm""",
    """CASE o_orderkey % 4 WHEN 1 THEN concat('{"kind":["', o_orderstatus, '"]}') WHEN 2 THEN '{"weekday":[1]}' ELSE '{}' END AS pn""",
    """CASE o_orderkey % 4 WHEN 0 THEN concat('{"weekday":[', o_custkey % 5 + 1, ',', o_custkey % 3 + 3, ',', 7, ']}') WHEN 1 THEN '{"course_lang":["英文"],"hour_range":[8,12]}' WHEN 2 THEN concat('{"point":', o_custkey % 2, '}') ELSE '{}' END AS gm""",
    """CASE o_orderkey % 4 WHEN 1 THEN '{"kind":["O"]}' WHEN 2 THEN concat('{"weekday":[', o_custkey % 2 + 1, ',5],"course_lang":["日文"]}') ELSE '{}' END AS gn""",
)
_SCORED_ROWS = "o_orderkey % 4 <> 0 OR (o_custkey % 5 + 1) <> (o_custkey % 3 + 3)"
_D = ("course_lang", "weekday", "hour_range", "point", "kind", "lmt_kind", "unit")
_SCORED_SQL = f"""
WITH r AS (SELECT {', '.join(SCORED)} FROM orders WHERE {_SCORED_ROWS}),
s AS (SELECT id, side, dimension, CASE side WHEN 'must' THEN pm ELSE pn END AS p, CASE side WHEN 'must' THEN gm ELSE gn END AS g FROM r, (VALUES ('must'), ('must_not')) a(side), (VALUES {', '.join(f"('{x}')" for x in _D)}) b(dimension)),
v AS (SELECT id, side, dimension, json_extract(p, '$.' || dimension) AS p, json_extract(g, '$.' || dimension) AS g FROM s),
w AS (SELECT id, side, dimension, CASE WHEN p IS NULL THEN [] WHEN json_type(p) = 'ARRAY' THEN CAST(p AS VARCHAR[]) ELSE [CAST(p AS VARCHAR)] END AS p, CASE WHEN g IS NULL THEN [] WHEN json_type(g) = 'ARRAY' THEN CAST(g AS VARCHAR[]) ELSE [CAST(g AS VARCHAR)] END AS g FROM v),
c AS (SELECT id, side, dimension, len(list_intersect(p, g)) AS tp, len(p) - len(list_intersect(p, g)) AS fp, len(g) - len(list_intersect(p, g)) AS fn FROM w),
f AS (SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE coalesce(tp / nullif(tp + fp, 0), 0.0) END AS pr, CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE coalesce(tp / nullif(tp + fn, 0), 0.0) END AS rc, CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM c),
x AS (SELECT id, avg(f1) AS slot_f1, bool_and(fp = 0 AND fn = 0) AS exact_match, sum(tp) FILTER (WHERE side = 'must_not') AS tp, sum(fp) FILTER (WHERE side = 'must_not') AS fp, sum(fn) FILTER (WHERE side = 'must_not') AS fn FROM f GROUP BY id),
y AS (SELECT id, slot_f1, exact_match, coalesce(tp / nullif(tp + fp, 0), 0.0) AS neg_p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS neg_r, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS neg_f1 FROM x)
"""


def scored(spark, d) -> DataFrame:
    rows = table(spark, d, "orders").where(_SCORED_ROWS).selectExpr(*SCORED)
    parse = lambda c: F.from_json(c, CONDITIONS)
    return rows.select("id", "has_negation", "complexity", parse("pm").alias("pred_must"), parse("pn").alias("pred_must_not"), parse("gm").alias("gold_must"), parse("gn").alias("gold_must_not"))


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("slot_prf", _SCORED_SQL + "SELECT id, side, dimension, round(pr, 6) AS p, round(rc, 6) AS r, round(f1, 6) AS f1 FROM f")
def slot_prf(spark, d):
    return _round(slots.slot_scores(scored(spark, d)), "p", "r", "f1").select("id", "side", "dimension", "p", "r", "f1")


@query("slot_f1", _SCORED_SQL + "SELECT id, round(slot_f1, 6) AS slot_f1 FROM y")
def slot_f1(spark, d):
    return _round(slots.per_row(slots.slot_scores(scored(spark, d))), "slot_f1").select("id", "slot_f1")


@query("exact_match", _SCORED_SQL + "SELECT id, exact_match FROM y")
def exact_match(spark, d):
    return slots.per_row(slots.slot_scores(scored(spark, d))).select("id", "exact_match")


@query("negation_f1", _SCORED_SQL + "SELECT id, round(neg_p, 6) AS neg_p, round(neg_r, 6) AS neg_r, round(neg_f1, 6) AS neg_f1 FROM y")
def negation_f1(spark, d):
    return _round(slots.per_row(slots.slot_scores(scored(spark, d))), "neg_p", "neg_r", "neg_f1").select("id", "neg_p", "neg_r", "neg_f1")


@query("aggregate_slot_metrics", _SCORED_SQL + "SELECT count(*) AS n, round(avg(slot_f1), 6) AS slot_f1, round(avg(CASE WHEN exact_match THEN 1.0 ELSE 0.0 END), 6) AS exact_match, round(avg(neg_p), 6) AS neg_p, round(avg(neg_r), 6) AS neg_r, round(avg(neg_f1), 6) AS neg_f1 FROM y")
def aggregate_slot_metrics(spark, d):
    return _round(slots.aggregate_metrics(slots.slot_scores(scored(spark, d))), "slot_f1", "exact_match", "neg_p", "neg_r", "neg_f1")


@query(
    "parser_summary",
    _SCORED_SQL + "SELECT count(*) AS n, round(avg(CASE WHEN exact_match THEN 1.0 ELSE 0.0 END), 4) AS exact_match, round(coalesce(avg(neg_f1) FILTER (WHERE has_negation), 0.0), 4) AS negation_f1, count(*) FILTER (WHERE has_negation) AS negation_n, (SELECT round(avg(m), 4) FROM (SELECT round(avg(f1), 4) AS m FROM f GROUP BY dimension)) AS overall_slot_f1 FROM y JOIN r USING (id)",
)
def parser_summary(spark, d):
    return slots.summarise(slots.slot_scores(scored(spark, d)), scored(spark, d))


@query("exact_match_by_complexity", _SCORED_SQL + "SELECT complexity, round(avg(CASE WHEN exact_match THEN 1.0 ELSE 0.0 END), 4) AS exact_match FROM y JOIN r USING (id) GROUP BY complexity")
def exact_match_by_complexity(spark, d):
    rows = scored(spark, d)
    each = slots.per_row(slots.slot_scores(rows)).join(rows.select("id", "complexity"), "id")
    return each.groupBy("complexity").agg(F.round(F.avg(F.col("exact_match").cast("double")), 4).alias("exact_match"))


@query("condition_present", f"SELECT id, gm <> '{{}}' OR gn <> '{{}}' AS present FROM (SELECT {', '.join(SCORED)} FROM orders WHERE {_SCORED_ROWS})")
def condition_present(spark, d):
    return scored(spark, d).select("id", predicates.has_conditions(F.col("gold_must"), F.col("gold_must_not")).alias("present"))
