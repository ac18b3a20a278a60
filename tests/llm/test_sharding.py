import numpy as np
import pytest

from quarry.llm.queries import op11_sharding
from quarry.llm.sharding import numbered, permuted, place_of, row_at, shard_rows, write_shards


@pytest.mark.parametrize("total", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation_and_back(total):
    every = np.arange(total)
    there = permuted(every, total, 7)
    assert sorted(there) == list(range(total))
    assert (permuted(there, total, 7, back=True) == every).all()


def test_large_totals_and_seeds():
    total = 3 * 10**13
    some = np.random.default_rng(1).integers(0, total, 5000)
    there = permuted(some, total, 1)
    assert ((0 <= there) & (there < total)).all()
    assert (permuted(there, total, 1, back=True) == some).all()
    assert (there != permuted(some, total, 2)).mean() > 0.99
    assert abs(there.mean() / total - 0.5) < 0.02 and abs(np.corrcoef(some, there)[0, 1]) < 0.05


def test_places_are_computable():
    for n in range(100):
        shard, slot = place_of(n, 100, 7)
        assert row_at(shard, slot, 100, 7) == n
    with pytest.raises(ValueError):
        row_at(2, 14, 100, 7)


def test_hostile_rows(spark):
    rows = [(1, "a", 5), (None, None, 6), (1, "a", 5), (2, "", 7)] + [(9, "copy", 0)] * 300 + [(3, "x" * 100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    out = shard_rows(docs, ["doc_id", "text"], 24).collect()
    assert out[0].__fields__ == ["doc_id", "text", "row_number", "shard", "slot"]
    assert sorted((r.doc_id or -1, r.text or "") for r in out) == sorted((a or -1, b or "") for a, b, _ in rows)
    n = len(rows)
    assert sorted(r.row_number for r in out) == list(range(n))
    assert all((r.shard, r.slot) == place_of(r.row_number, n) for r in out)
    in_order = sorted(out, key=lambda r: r.row_number)
    assert [r.doc_id for r in in_order] == [None, 1, 1, 2, 3] + [9] * 300
    slots = {s: sorted(r.slot for r in out if r.shard == s) for s in range(24)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_same_whatever_the_partitions(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "cast(id % 7 as string) as text")
    a, b = ({tuple(r) for r in shard_rows(d, ["doc_id"], 5).collect()} for d in (docs.repartition(9), docs.coalesce(1)))
    assert a == b


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert shard_rows(docs, ["doc_id"]).count() == 0
    assert numbered(docs, ["doc_id"]).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.range(100).selectExpr("id as doc_id", "concat('t', id) as text")
    write_shards(docs, ["doc_id"], str(tmp_path / "shards"), 4)
    for shard in range(4):
        back = spark.read.parquet(str(tmp_path / "shards" / f"shard={shard}")).orderBy("slot").collect()
        assert [r.doc_id for r in back] == [row_at(shard, i, 100, 4) for i in range(25)]


def test_query_columns(spark):
    out = op11_sharding(spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
