"""Sources and sinks: catalogs, JSON lines, and tables kept up to date by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVAL_ROWS


def read_catalog(spark: SparkSession, path: str, year: str | None = None, semester: str | None = None) -> DataFrame:
    """A Parquet catalog; year and semester are pushed down to the scan."""
    rows = spark.read.parquet(path)
    if year is not None:
        rows = rows.where(F.col("y") == year)
    return rows if semester is None else rows.where(F.col("s") == semester)


def read_database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of SQLite, PostgreSQL or any database with a JDBC driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_json_lines(spark: SparkSession, path: str, schema: str = EVAL_ROWS, drop_malformed: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped, and malformed ones are dropped or give nulls."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED" if drop_malformed else "PERMISSIVE").json(path)
    return rows


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def gold_of(gold: Column, single: Column) -> Column:
    """The gold list, or the single gold id in a list where the list is empty; a row without either gets a list of null."""
    return F.array_distinct(F.when(F.coalesce(F.size(gold) > 0, F.lit(False)), gold).otherwise(F.array(single)))


def _one_a_key(rows: DataFrame, keys: tuple[str, ...], order: Column | None) -> DataFrame:
    """One row a key: the greatest by ``order``, or else by the other columns, so that a repeated task picks the same."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.struct(*([order.alias("order")] if order is not None else []), *rest)
    picked = rows.groupBy(*keys).agg(F.max(best).alias("best"))
    return picked.select(*keys, *(F.col("best")[c].alias(c) for c in rest)).select(*rows.columns)


def latest_by_key(old: DataFrame, new: DataFrame, *keys: str, order: Column | None = None) -> DataFrame:
    """An upsert: the rows of both, where a new row takes the place of an old one with its key.

    Of several new rows with one key the last by ``order`` counts, or the greatest by its other columns.
    """
    chosen = _one_a_key(new, keys, order)
    return old.join(chosen.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(chosen, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, *keys: str, order: Column | None = None) -> DataFrame:
    """An insert that leaves rows alone whose key is there, and puts one row in for each key that isn't."""
    return old.unionByName(_one_a_key(new.join(old.select(*keys), list(keys), "left_anti"), keys, order), allowMissingColumns=True)


def not_done(todo: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    return todo.join(done.select(*keys), list(keys), "left_anti")


def json_strings(column: Column) -> Column:
    """A JSON array in text as an array of strings; items that aren't strings are dropped, and null or bad JSON is empty."""
    items = F.from_json(F.when(F.try_parse_json(column).isNotNull(), column), "array<variant>")
    text = F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return F.coalesce(F.filter(text, lambda t: t.isNotNull()), F.array().cast("array<string>"))
