"""Write-through caches: an encoder sees each text once, however often and by whom it is asked."""

from pyspark.sql import functions as F

from quarry.functions.text import row_key
from quarry.session import scratch_path
from quarry.sources.cache import new_cache, through_cache
from quarry.sources.keyed import open_table


def texts(spark, *found):
    return spark.createDataFrame([(t,) for t in found], "text string").select(row_key(F.lit("m"), F.col("text")).alias("key"), "text")


def encoder(spark):
    seen = spark.sparkContext.accumulator(0)

    def encode(batches):
        for batch in batches:
            seen.add(len(batch))
            batch["vector"] = [[float(len(t))] for t in batch["text"]]
            yield batch[["key", "vector"]]

    return seen, lambda rows: rows.mapInPandas(encode, "key string, vector array<double>")


def lengths(rows):
    return sorted(r.vector[0] for r in rows.collect())


def test_second_run_calls_no_encoder(spark):
    seen, make = encoder(spark)
    cache = new_cache(spark, scratch_path(spark, "cache"), "vector array<double>", buckets=8)
    found, after = through_cache(texts(spark, "a", "bb", "bb", "ccc", None), cache, make)
    assert lengths(found) == [1, 2, 3] and lengths(found) == [1, 2, 3] and seen.value == 3
    found, same = through_cache(texts(spark, "bb", "ccc"), open_table(spark, cache.path), make)
    assert lengths(found) == [2, 3] and seen.value == 3 and same.version == after.version
    found, _ = through_cache(texts(spark, "bb", "dddd"), same, make)
    assert lengths(found) == [2, 4] and seen.value == 4
    assert lengths(open_table(spark, cache.path).rows()) == [1, 2, 3, 4]


def test_another_writer_comes_first(spark):
    seen, make = encoder(spark)
    cache = new_cache(spark, scratch_path(spark, "cache"), "vector array<double>", buckets=8)
    through_cache(texts(spark, "a", "bb"), cache, make)
    found, last = through_cache(texts(spark, "bb", "ccc"), cache, make)  # still holds the empty version
    assert lengths(found) == [2, 3] and seen.value == 4
    assert lengths(last.rows()) == [1, 2, 3]


def test_empty(spark):
    seen, make = encoder(spark)
    cache = new_cache(spark, scratch_path(spark, "cache"), "vector array<double>")
    found, same = through_cache(texts(spark, None), cache, make)
    assert found.count() == 0 and same.version == cache.version and seen.value == 0
