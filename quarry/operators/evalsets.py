"""Evaluation sets: merged, cleaned, sampled and described."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import query_key, strip
from ..session import scratch_path


PERSONAS = ("topic", "constraint", "colloquial")


def chat_answers(lines: DataFrame) -> DataFrame:
    """id, content of batch answers in the chat format (id, line): the first choice's message."""
    return lines.select("id", F.get_json_object("line", "$.response.body.choices[0].message.content").alias("content"))


def block_answers(lines: DataFrame) -> DataFrame:
    """id, content of batch answers in the block format: the text blocks of those that succeeded, joined."""
    parsed = lines.select("id", F.from_json("line", "result struct<type:string,message:struct<content:array<struct<type:string,text:string>>>>").alias("r")).where("r.result.type = 'succeeded'")
    return parsed.select("id", F.array_join(F.transform(F.filter("r.result.message.content", lambda b: b["type"] == "text"), lambda b: b["text"]), "").alias("content"))


def personas(answers: DataFrame, kinds: tuple[str, ...] = PERSONAS) -> DataFrame:
    """id, kind, query: a row for each kind of query that an answer (a JSON object) holds, blanks dropped."""
    parsed = answers.select("id", F.from_json("content", ", ".join(f"{k} string" for k in kinds)).alias("c"))
    each = F.array(*(F.struct(F.lit(k).alias("kind"), strip(F.col("c")[k]).alias("query")) for k in kinds))
    return parsed.select("id", F.inline(each)).where("query <> ''")


def listed_texts(answers: DataFrame, field: str, least: int = 5) -> DataFrame:
    """id and texts (in a column named ``field``) of an answer that is a list, an object or a wrapped list of texts or objects; shorter ones are dropped."""
    rows = answers.withColumn("v", F.try_parse_json("answer"))
    many = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", "$.queries", "array<variant>"), F.array(F.col("v")))
    each = rows.where("v is not null").select("id", F.explode(many).alias("x"))
    text = F.coalesce(F.try_variant_get("x", f"$.{field}", "string"), F.when(F.schema_of_variant("x") == "STRING", F.try_variant_get("x", "$", "string")))
    return each.select("id", text.alias(field)).where(F.length(field) >= least)


def merge_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows (gold, query, ...) of all sources; of rows with one gold and one normalised query the first source's first stays."""
    out = None
    for i, (name, rows) in enumerate(sources.items()):
        part = rows.withColumn("source", F.lit(name)).withColumn("source_order", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    order = Window.partitionBy("gold", query_key(F.col("query"))).orderBy("source_order", "query")
    return out.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth", "source_order")


def first_seen(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key by an explicit order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def numbered(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """Numbers rows from 0 by an order that tells all rows apart: ranges are sorted by themselves, and each starts where those before it end."""
    path = scratch_path(rows.sparkSession, "numbered")
    rows.repartitionByRange(*order).withColumn("range_id", F.spark_partition_id()).write.parquet(path)
    placed = rows.sparkSession.read.parquet(path)
    sizes = placed.groupBy("range_id").agg(F.count(F.lit(1)).alias("rows_here"))
    starts = sizes.withColumn("begin", F.sum("rows_here").over(Window.orderBy("range_id")) - F.col("rows_here")).drop("rows_here")  # a row a range
    nth = F.row_number().over(Window.partitionBy("range_id").orderBy(*order))
    return placed.withColumn("nth", nth).join(F.broadcast(starts), "range_id").withColumn(name, F.col("begin") + F.col("nth") - 1).drop("range_id", "nth", "begin")


def hash_order(seed: str, column: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), column.cast("string")))


def hash_sample(rows: DataFrame, column: str, n: int, seed: str = "42") -> DataFrame:
    """n rows in a reproducible random order."""
    return rows.orderBy(hash_order(seed, F.col(column)), column).limit(n)


def stratified_sample(rows: DataFrame, stratum: str, column: str, ratios: dict[str, float], n: int, seed: str = "42") -> DataFrame:
    """round(n * ratio) rows of each stratum, without replacement, in hash order."""
    table = F.create_map(*(x for k, v in ratios.items() for x in (F.lit(k), F.lit(round(n * v)))))
    order = Window.partitionBy(stratum).orderBy(hash_order(seed, F.col(column)), column)
    out = rows.withColumn("nth", F.row_number().over(order))
    return out.where(F.col("nth") <= F.coalesce(F.try_element_at(table, F.col(stratum)), F.lit(0))).drop("nth")


def pick(values: Column, seed: str, row: Column) -> Column:
    """One of an array's values by the hash of a row's id; null of none."""
    number = F.conv(F.substring(hash_order(seed, row), 1, 8), 16, 10).cast("long")
    return F.when(F.size(values) > 0, F.get(values, F.pmod(number, F.size(values)).cast("int")))


def complexity(n_must: Column, n_must_not: Column) -> Column:
    n = n_must + n_must_not
    return F.when(n <= 1, "single").when(n == 2, "multi").otherwise("complex")


def inconsistencies(reasons: dict[str, Column]) -> Column:
    """The names of the checks that fail, in order."""
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in reasons.items())))


def pool_statistics(sizes: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: n_queries, avg_pool, median_pool (the upper one), min_pool, max_pool of sizes (qid, n), and gold_in_pool, the share of qrels that is ``inside``."""
    upper = F.expr("percentile_disc(0.5) within group (order by n desc)").cast("long")
    total = sizes.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("n"), 6).alias("avg_pool"), upper.alias("median_pool"), F.min("n").alias("min_pool"), F.max("n").alias("max_pool"))
    return total.crossJoin(F.broadcast(qrels.agg(F.round(F.avg(F.col("inside").cast("int")), 6).alias("gold_in_pool"))))


def consistency(c: Column, known: Column, sessions: Column, lang: Column, unit: Column, point: Column, kind: Column) -> dict[str, Column]:
    """Which of a query's parsed constraints ``c`` its gold record fails, by name; a check without a value on either side passes.

    ``known`` tells whether the record exists; the others are its fields.
    """
    hours = F.flatten(F.transform(sessions, lambda s: F.when(s["end_hour"] > s["start_hour"], F.sequence(s["start_hour"], s["end_hour"] - 1)).otherwise(F.array().cast("array<int>"))))
    bounded = c["hour_min"].isNotNull() | c["hour_max"].isNotNull()
    inside = F.exists(hours, lambda h: (c["hour_min"].isNull() | (h >= c["hour_min"])) & (c["hour_max"].isNull() | (h <= c["hour_max"])))
    named = lambda field, words: F.exists(words, lambda w: F.contains(F.coalesce(field, F.lit("")), w))
    worth = F.coalesce(point, F.lit(0.0))
    both = c["point_min"].isNotNull() & c["point_max"].isNotNull()
    bad = {
        "lang": (F.size(c["lang_include"]) > 0) & ~named(lang, c["lang_include"]),
        "weekday": (F.size(c["weekday_include"]) > 0) & (F.size(sessions) > 0) & ~F.exists(sessions, lambda s: F.array_contains(c["weekday_include"], s["weekday"])),
        "hour": bounded & (F.size(hours) > 0) & ~inside,
        "unit": (F.size(c["unit_include"]) > 0) & ~named(unit, c["unit_include"]),
        "point": both & ~worth.between(c["point_min"], c["point_max"]),
        "kind": (F.size(c["kind_include"]) > 0) & ~F.coalesce(F.array_contains(c["kind_include"], kind), F.lit(False)),
    }
    return {"not_in_db": ~known, **{name: known & F.coalesce(failed, F.lit(False)) for name, failed in bad.items()}}


#: Checks of the first consistency report, which names the first failure, and of the second, which names all.
FIRST_CHECKS, ALL_CHECKS = ("not_in_db", "weekday", "hour", "kind"), ("not_in_db", "lang", "weekday", "hour", "unit", "point")


def describe_text(rows: DataFrame, text: str) -> DataFrame:
    """One row: n, missing, and mean, median, 90th percentile (interpolated, cut to whole numbers) and maximum of lengths."""
    n = F.length(F.coalesce(text, F.lit("")))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(n == 0).alias("missing"), F.round(F.avg(n), 4).alias("mean_len"),
        F.percentile(n, F.lit(0.5)).cast("long").alias("median_len"), F.percentile(n, F.lit(0.9)).cast("long").alias("p90_len"), F.max(n).cast("long").alias("max_len"),
    )
