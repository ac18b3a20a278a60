"""Native expressions against small plain versions, on fixed and random inputs."""

import random
import unicodedata

from pyspark.sql import functions as F

from quarry.functions import parsers as N
from quarry.functions import text as T
from quarry.operators import predicates as P
from quarry.schema import CONSTRAINTS


def slots_plain(s):
    """Sessions of a string whose periods follow a weekday."""
    if s.strip() in ("", "未定", "未定或彈性"):
        return []
    out, day, run = [], None, ""
    for c in s + "\0":
        period = T.PERIODS.find(c) if c in T.PERIODS else -1
        follows = run and period >= 0 and period == T.PERIODS.index(run[-1]) + 1
        if follows:
            run += c
            continue
        if (period >= 0 or c in T.WEEKDAYS or c == "\0") and run and day is not None:
            first, last = T.PERIODS.index(run[0]), T.PERIODS.index(run[-1])
            out.append((T.WEEKDAYS.index(day) + 1, first + 6, last + 7))
            run = ""
        if c in T.WEEKDAYS:
            day = c
        elif period >= 0:
            run = c
    return out


def test_time_slots_random(spark):
    rng = random.Random(1)
    texts = [rng.choice(T.WEEKDAYS) + "".join(rng.choice(T.PERIODS + T.WEEKDAYS + " x") for _ in range(rng.randrange(9))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", T.time_slots(F.col("s")).alias("x")).collect()
    for r in rows:
        assert [(x.weekday, x.start_hour, x.end_hour) for x in r.x] == slots_plain(r.s), r.s


def test_negation_window_random(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("不要想別開排除外避課的英文") for _ in range(rng.randrange(1, 24))) for _ in range(200)]
    for words, window in ((N.RULE_NEGATIONS, 8), (N.PATTERN_NEGATIONS, 10)):
        rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: N.negated(F.col("s"), i, words, window)).alias("x"))
        for r in rows.collect():
            assert r.x == [any(w in r.s[max(0, i - window) : i] for w in words) for i in range(len(r.s))], r.s


def test_nfkc(spark):
    texts = ["ＡＢＣ１２３", "ﬁ", "é", None, "①"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", T.nfkc("s").alias("x")).collect()
    for r in rows:
        assert r.x == (None if r.s is None else unicodedata.normalize("NFKC", r.s))


def test_clean_null_is_empty(spark):
    row = spark.createDataFrame([(None, " &amp;Ａ　")], "a string, b string").select(T.clean(F.col("a")).alias("a"), T.clean(F.col("b")).alias("b")).first()
    assert (row.a, row.b) == ("", "A")


def test_bigrams(spark):
    row = spark.createDataFrame([("資訊 管理",)], "s string").select(T.character_bigrams(F.col("s")).alias("x")).first()
    assert row.x == ["資訊", "訊管", "管理"]


def one(spark, sessions, constraint, lang="中文", kind=1, point=3.0, unit="資訊系"):
    none = {k: "array()" for k in ("weekday_include", "weekday_exclude", "hour_exclude_ranges", "lang_include", "lang_exclude", "kind_include", "kind_exclude", "unit_include", "unit_exclude")}
    parts = {**none, "hour_min": "null", "hour_max": "null", "point_min": "null", "point_max": "null", "residual": "''", **constraint}
    order = [x.split(":")[0] for x in CONSTRAINTS[len("struct<") :].replace("array<struct<low:int,high:int>>", "x").rstrip(">").split(",")]
    c = F.expr("named_struct(" + ", ".join(f"'{k}', {parts[k]}" for k in order) + ")").cast(CONSTRAINTS)
    df = spark.createDataFrame([(sessions, lang, kind, point, unit)], "sessions array<struct<weekday:int,start_hour:int,end_hour:int>>, lang string, kind int, point double, unit string")
    return df.select(P.passes(*(F.col(x) for x in ("sessions", "lang", "kind", "point", "unit")), c).alias("x")).first().x


def test_constraints(spark):
    s = [(1, 9, 11), (4, 14, 16)]
    assert one(spark, s, {"weekday_include": "array(1)"})
    assert not one(spark, s, {"weekday_include": "array(2)"})
    assert not one(spark, [], {"weekday_include": "array(1)"})
    assert not one(spark, s, {"weekday_exclude": "array(4)"})
    assert one(spark, s, {"hour_min": "10", "hour_max": "12"})
    assert not one(spark, s, {"hour_min": "17"})
    assert one(spark, [], {"hour_min": "10", "hour_max": "12"})
    assert not one(spark, s, {"hour_exclude_ranges": "array(named_struct('low', 8, 'high', 18))"})
    assert one(spark, s, {"hour_exclude_ranges": "array(named_struct('low', 13, 'high', 18))"})
    assert not one(spark, s, {"lang_exclude": "array('英文')"}, lang="英文")
    assert one(spark, s, {"lang_exclude": "array('英文')"})
    assert one(spark, s, {"lang_exclude": "array('英文')"}, lang=None)
    assert not one(spark, s, {"kind_include": "array(2)"})
    assert not one(spark, s, {"point_min": "1.0D"}, point=None)
    assert one(spark, s, {"unit_include": "array('資訊')"})
    assert not one(spark, s, {"unit_exclude": "array('資訊')"})
