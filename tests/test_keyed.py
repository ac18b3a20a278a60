"""Keyed tables: changes touch only their buckets, and a version is there whole or not at all."""

import pytest
from pyspark.sql import functions as F

from quarry.session import scratch_path
from quarry.sources import keyed

SCHEMA = "key int, value string, at int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def table(spark):
    return keyed.create(spark.createDataFrame([(i, "old", 0) for i in range(40)], SCHEMA), scratch_path(spark, "keyed"), "key", buckets=16)


def test_upsert_copies_its_buckets_only(spark, table):
    new = spark.createDataFrame([(2, "x", 5), (2, "y", 4), (100, "p", 1), (100, "q", 1), (None, "n", 1)], SCHEMA)
    after = table.upsert(new, order=F.col("at"))
    want = [(i, "old", 0) for i in range(40) if i != 2] + [(2, "x", 5), (100, "q", 1), (None, "n", 1)]
    assert rows(after.rows()) == rows(keyed.open_table(spark, table.path).rows()) == sorted(want, key=str)
    changed = {b for b in range(16) if after.parts.get(b) != table.parts.get(b)}
    assert changed == set(table.touched(new)) and len(changed) <= 3
    assert rows(after.upsert(spark.createDataFrame([(None, "m", 2)], SCHEMA)).rows()).count((None, "m", 2)) == 1  # null is one key
    assert rows(table.rows()) == rows(keyed.open_table(spark, table.path, 0).rows()) == sorted([(i, "old", 0) for i in range(40)], key=str)


def test_insert_adds_files_and_copies_none(spark, table):
    after = table.insert_absent(spark.createDataFrame([(2, "x", 5), (100, "p", 1), (100, "q", 1)], SCHEMA))
    assert rows(after.rows()) == sorted([(i, "old", 0) for i in range(40)] + [(100, "q", 1)], key=str)
    for b, writes in table.parts.items():
        assert after.parts[b][: len(writes)] == writes
    again = after.insert_absent(spark.createDataFrame([(100, "z", 9)], SCHEMA))
    assert again.parts == after.parts and rows(again.rows()) == rows(after.rows())


def test_delete_and_find(spark, table):
    gone = spark.createDataFrame([(i,) for i in range(0, 40, 2)] + [(77,)], "key int")
    after = table.delete(gone)
    assert [r[0] for r in rows(after.rows())] == sorted(range(1, 40, 2), key=str)
    assert rows(after.find(spark.createDataFrame([(1,), (2,), (3,)], "key int"))) == [(1, "old", 0), (3, "old", 0)]
    assert after.delete(spark.createDataFrame([(i,) for i in range(40)], "key int")).rows().count() == 0


def test_a_writer_that_dies_leaves_the_old_table(spark, table, monkeypatch):
    bad = spark.range(50).select(F.col("id").cast("int").alias("key"), F.when(F.col("id") == 37, F.raise_error(F.lit("lost"))).otherwise(F.lit("new")).cast("string").alias("value"), F.lit(1).alias("at"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(bad)
    monkeypatch.setattr(keyed, "_put", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):  # the rows are written, their version isn't
        table.upsert(spark.createDataFrame([(1, "new", 1)], SCHEMA))
    now = keyed.open_table(spark, table.path)
    assert now.version == 0 and rows(now.rows()) == sorted([(i, "old", 0) for i in range(40)], key=str)


def test_of_two_writers_one_wins(spark, table):
    table.upsert(spark.createDataFrame([(1, "first", 1)], SCHEMA))
    with pytest.raises(keyed.Conflict):
        table.upsert(spark.createDataFrame([(1, "second", 1)], SCHEMA))
    again = keyed.open_table(spark, table.path).upsert(spark.createDataFrame([(2, "second", 1)], SCHEMA))
    assert {r for r in rows(again.rows()) if r[1] != "old"} == {(1, "first", 1), (2, "second", 1)}
