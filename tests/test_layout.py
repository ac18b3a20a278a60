"""Catalog layout and literal conditions: the same rows as the compiled conditions, predicates at the scan, groups and folders skipped."""

import random

from pyspark.sql import functions as F

from quarry.operators.predicates import literal_matches, matches
from quarry.schema import CONDITIONS, SESSIONS
from quarry.session import scratch_path
from quarry.sources.layout import in_folders_of, write_catalog

SCHEMA = f"course_id long, y int, s string, lang string, kind int, lmt_kind string, point double, unit string, sessions {SESSIONS}, weekdays array<int>"
NAMES = ("lang", "kind", "lmt_kind", "point", "unit", "sessions", "weekdays")


def doc():
    return {name: F.col(name) for name in NAMES}


def catalog(spark, n=2_000):
    chance = random.Random(8)
    rows = []
    for i in range(n):
        day, hour = chance.randint(1, 7), chance.randint(8, 20)
        sessions = chance.choice([[(day, hour, hour + 2)], [], None])
        rows.append((i, chance.choice([110, 111, 111, None]), chance.choice(["1", "2"]), chance.choice(["中文", "英文", "日文", None]), chance.choice([1, 2, 3, None]), chance.choice(["a", "b", None]), chance.choice([1.0, 2.0, 3.0, None]), chance.choice(["資訊系", "資_系", "法律系", "", None]), sessions, None if sessions is None else [x[0] for x in sessions]))
    return spark.createDataFrame(rows, SCHEMA)


def scan_of(df):
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0)


def metric(df, name):
    return scan_of(df).metrics().apply(name).value()


def test_the_same_as_compiled_conditions(spark):
    chance = random.Random(6)
    rows = catalog(spark).repartition(2).cache()
    pick = lambda values: chance.choice([None, [], [chance.choice(values)], chance.sample(values, 2)])
    for _ in range(25):
        sides = []
        for _ in range(2):
            given = {"course_lang": pick(["中文", "英文", "德文"]), "weekday": pick([1, 2, 5]), "hour_range": chance.choice([None, [9], [9, 12]]), "point": chance.choice([None, None, 2.0]), "kind": pick(["必修", "選修", "沒有"]), "lmt_kind": pick(["a", "c"]), "unit": pick(["資_", "律", "%系"])}
            sides.append({name: value if chance.random() < 0.4 else None for name, value in given.items()})
        table = spark.createDataFrame([tuple(sides)], f"must {CONDITIONS}, must_not {CONDITIONS}")
        want = rows.crossJoin(table).where(matches(doc(), F.col("must"), F.col("must_not"))).select("course_id")
        got = rows.where(literal_matches(doc(), *sides)).select("course_id")
        assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in want.collect()), sides
    rows.unpersist()


def test_scan_gets_the_conditions_and_skips(spark):
    rows = catalog(spark, 20_000)
    stored = write_catalog(rows, scratch_path(spark, "catalog"), "course_id", order=("lang", "point"), rows_a_file=700)
    assert stored.schema == rows.schema
    assert sorted(map(str, stored.collect())) == sorted(map(str, rows.collect()))
    wanted = literal_matches(doc(), {"course_lang": ["英文", "日文"], "point": 2.0, "unit": ["資訊"]})
    found = stored.where((F.col("y") == 111) & (F.col("s") == "2") & wanted)
    plan = scan_of(found).toString()
    for pushed in ("In(lang, [", "EqualTo(point,2.0)", "StringContains(unit,"):
        assert pushed in plan.split("PushedFilters")[1], plan
    assert "y#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    in_term = rows.where("y = 111 and s = '2'")
    assert found.count() == in_term.where(wanted).count() > 0
    found.collect()
    read, all_rows = metric(found, "numOutputRows"), in_term.count()
    assert 0 < read < all_rows / 2, (read, all_rows)  # files whose statistics exclude the language or the points are not read


def test_wanted_terms_prune_folders(spark):
    stored = write_catalog(catalog(spark), scratch_path(spark, "catalog"), "course_id")
    terms = spark.createDataFrame([(110, "1", 5), (110, "1", 6), (111, "2", 1), (None, "1", 9)], "y int, s string, asked int")
    path = scratch_path(spark, "terms")
    terms.write.parquet(path)
    found = in_folders_of(stored, spark.read.parquet(path).where("asked > 4"), "y", "s")
    assert "dynamicpruning" in found._jdf.queryExecution().toString()
    assert sorted(r.course_id for r in found.collect()) == sorted(r.course_id for r in stored.where("y = 110 and s = '1'").collect())


def test_empty_catalog_and_hot_term(spark):
    rows = catalog(spark)
    assert write_catalog(rows.limit(0), scratch_path(spark, "catalog"), "course_id").count() == 0
    hot = rows.withColumn("y", F.lit(111)).withColumn("s", F.lit("1")).withColumn("lang", F.lit("中文")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = write_catalog(hot, scratch_path(spark, "catalog"), "course_id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 1 and sum(sizes) == 2_000 and max(sizes) < 1_500
