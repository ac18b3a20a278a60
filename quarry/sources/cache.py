"""Write-through caches by content key: what is there is read, what isn't is made once and kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .keyed import Conflict, KeyedTable, create, open_table

#: How often other writers may be first before a caller gives up.
TRIES = 20


def new_cache(spark: SparkSession, path: str, columns: str, buckets: int = 64) -> KeyedTable:
    """An empty cache with a key and ``columns``, such as ``vector array<double>``."""
    return create(spark.createDataFrame([], f"key string, {columns}"), path, "key", buckets=buckets)


def through_cache(wanted: DataFrame, cache: KeyedTable, make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, KeyedTable]:
    """The cache's rows for the keys of ``wanted`` (key and what ``make`` needs), and the cache that holds them all.

    ``make`` gets the rows whose key is missing, one a key (the least of several), and gives rows of the cache's columns.  They are stored before anything
    else reads them: neither a repeated task of a later stage nor another writer's new version makes them again.  A key for which ``make``
    gives no row is asked again next time.  Rows without a key find nothing.
    """
    rest = [c for c in wanted.columns if c != "key"]
    one = wanted.where("key is not null").groupBy("key").agg(F.min(F.struct(*rest)).alias("rest")).select("key", "rest.*")
    one = stored(one, "wanted")
    missing = stored(one.join(cache.rows(cache.touched(one)).select("key"), "key", "left_anti"), "missing")
    if not missing.isEmpty():
        made = stored(make(missing), "made")
        for left in range(TRIES, 0, -1):
            try:
                cache = cache.insert_absent(made)
                break
            except Conflict:
                if left == 1:
                    raise
                cache = open_table(cache.spark, cache.path)
    return cache.find(one), cache
