"""What the operators share: tables in the shared folder, and joins that survive hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: A key with at least this share of a table's rows is hot; so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 1 / 1000
#: Broadcasts of measured tables stop at this many rows.
BROADCAST_ROWS = 1_000_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends there, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more: all that was made from them is stored itself."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def lookup(df: DataFrame, table: DataFrame, keys: list[str], values: list[str], rows: str, spread: Column) -> DataFrame:
    """Left join of ``df`` with ``table`` (one row a key; values not null) that no hot key of ``df`` can skew.

    Column ``rows`` of the table says how many rows of ``df`` have the key.  Keys
    with HOT_SHARE of them or more, hence at most 1000, are broadcast.  The
    other rows meet the table in a shuffle; there, rows of hot keys carry a
    salt made from ``spread``, which matches nothing, and so lie evenly.  Without hot keys it is a plain join.
    """
    table = stored(table.select(*keys, *values, rows), "lookup")  # as a file it has no partitioning, so the salt takes part in the next one
    total, most = table.agg(F.sum(rows), F.max(rows)).first()
    least = max((total or 0) * HOT_SHARE, 100)
    if (most or 0) < least:
        return df.join(table.select(*keys, *values), keys, "left").select(*df.columns, *values)
    of_hot = table.where(F.col(rows) >= least).select(*keys, *(F.col(v).alias(f"hot_{v}") for v in values))
    rest = table.where(F.col(rows) < least).select(*(F.col(k).alias(f"rest_{k}") for k in keys), F.lit(0).alias("rest_salt"), *values)
    found = df.join(F.broadcast(of_hot), keys, "left")
    salt = F.when(F.col(f"hot_{values[0]}").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(1 << 30)).cast("int") + 1).otherwise(0)
    found = found.withColumn("use_salt", salt)
    on = F.col("use_salt") == F.col("rest_salt")
    for k in keys:
        on = on & (F.col(k) == F.col(f"rest_{k}"))
    joined = found.join(rest, on, "left")
    return joined.select(*df.columns, *(F.coalesce(f"hot_{v}", v).alias(v) for v in values))


def carried(docs: DataFrame, keys: list[Column]) -> DataFrame:
    """whole (a row's columns, of any names and types) and its keys k0, k1, ..."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(whole.alias("whole"), *(k.alias(f"k{i}") for i, k in enumerate(keys)))


def on_keys(table: DataFrame) -> Column:
    """Rows of carried() whose keys equal the columns of ``table``, in order; nulls are equal."""
    equal = [F.col(f"k{i}").eqNullSafe(table[c]) for i, c in enumerate(table.columns)]
    return reduce(Column.__and__, equal)


def rows_of(docs: DataFrame, keys: list[Column], table: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose keys are (left_semi) or are not (left_anti) in ``table``."""
    return carried(docs, keys).join(table, on_keys(table), how).select("whole.*")
