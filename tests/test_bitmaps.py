"""Pools from bitmaps against the compiled conditions, document by document."""

import random

from pyspark.sql import functions as F

from quarry.operators import bitmaps, lexical
from quarry.operators import predicates as P
from quarry.schema import CONDITIONS

NAMES = ("lang", "unit", "kind", "sessions", "weekdays", "point", "lmt_kind")


def test_pools_equal_conditions(spark, monkeypatch):
    rng = random.Random(8)
    maybe = lambda *values: rng.choice([*values, None])
    sessions = lambda: maybe([], [(1, 9, 11)], [(2, 13, 16), (5, 9, 12)])
    rows = [(i, f"t{i} common", maybe("en", "fr"), maybe("法律系", "a%b", "ab"), maybe(1, 2, 3), sessions(), maybe([], [1], [2, 5]), maybe(2.0, 3.0), maybe("x", "y")) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, unit string, kind int, sessions array<struct<weekday:int,start_hour:int,end_hour:int>>, weekdays array<int>, point double, lmt_kind string")

    def side(filled):
        pick = lambda *values: rng.choice(values) if rng.random() < filled else rng.choice([[], None])
        return (pick(["en"], ["fr", "de"]), pick([1], [2, 3]), pick([8, 12], [12, 13], [10]), rng.choice([2.0, 3.0]) if rng.random() < filled else None, pick(["必修"], ["選修", "通識"], ["無"]), pick(["x"], ["y", "z"]), pick(["法律"], ["a%"], ["b", "系"]))

    asked = [(q, side(0.25), side(0.15)) for q in range(40)] + [(98, side(0), side(0)), (99, side(1), side(0))]
    fields = "course_lang array<string>, weekday array<int>, hour_range array<int>, point double, kind array<string>, lmt_kind array<string>, unit array<string>"
    fields = ",".join(f.strip().replace(" ", ":", 1) for f in fields.split(", "))
    conditions = spark.createDataFrame(asked, f"qid long, must struct<{fields}>, must_not struct<{fields}>").select("qid", F.col("must").cast(CONDITIONS).alias("must"), F.col("must_not").cast(CONDITIONS).alias("must_not"))
    doc = {n: F.col(n) for n in NAMES}
    want = {(r.qid, r.doc_id) for r in docs.crossJoin(conditions).where(P.matches(doc, F.col("must"), F.col("must_not"))).select("qid", "doc_id").collect()}
    index = lexical.write_index(docs)
    pool = bitmaps.pools(conditions, bitmaps.attribute_bits(docs, index, doc))
    got = {(r.qid, r.doc_id) for r in bitmaps.pool_members(conditions, pool, index).collect()}
    assert got == want and len(want) > 300
    sizes = {r.qid: r.n for r in bitmaps.pool_sizes(conditions, pool, index).collect()}
    assert sizes == {q: sum(1 for a, _ in want if a == q) for q, *_ in asked}
    some = spark.createDataFrame([(q, d) for q, *_ in asked for d in range(0, 160, 7)], "qid long, doc_id long")
    assert all(r.inside == ((r.qid, r.doc_id) in want) for r in bitmaps.in_pool(some, pool, index).collect())
    assert pool.masks.where("qid = 98").count() == 0  # no rows for a query without conditions
    queries = conditions.select("qid", F.lit("common").alias("text"))
    found = {(r.qid, r.doc_id) for r in lexical.bm25_search(queries, index, 1000, pool).collect()}
    assert found <= want and {q for q, _ in found} == {q for q, _ in want}
