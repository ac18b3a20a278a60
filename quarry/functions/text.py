"""Text functions on columns.  All but NFKC are built-in expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A token starts with, and consists of, letters, digits and underscores of any script.
TOKEN = r"[\p{L}\p{N}_]+"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once a row, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tokens(text: Column) -> Column:
    """Word tokens in order, case kept; null and empty text give none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))


def character_bigrams(text: Column) -> Column:
    """Overlapping pairs of letters: a segmentation of unspaced scripts that needs no dictionary."""
    letters = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", ""), ""), lambda c: c != "")
    return F.when(F.size(letters) < 2, letters).otherwise(F.zip_with(F.slice(letters, 1, F.greatest(F.size(letters) - 1, F.lit(0))), F.slice(letters, 2, F.greatest(F.size(letters) - 1, F.lit(0))), lambda a, b: F.concat(a, b)))


def mixed_tokens(text: Column) -> Column:
    """Word tokens, of which those in Han script, which has no spaces, are cut into overlapping pairs: a tokenizer for Chinese catalogs."""
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
    return F.flatten(F.transform(tokens(text), lambda t: F.when(t.rlike(r"\p{IsHan}"), pairs(t)).otherwise(F.array(t))))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC, for which no expression exists."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def strip_entities(text: Column) -> Column:
    """HTML entities removed, not decoded."""
    return F.regexp_replace(text, r"&[a-zA-Z]+;|&#\d+;", "")


def strip_info_prefix(text: Column) -> Column:
    """Notice markers at line starts removed."""
    return F.regexp_replace(text, r"(?m)^[＠@](異動資訊|備註|Information|Note)\s*[:：]\s*", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean(text: Column, normalise: bool = True) -> Column:
    """NFKC, entities, notice markers, outer blanks; null is empty."""
    body = F.coalesce(text, F.lit(""))
    return strip(strip_info_prefix(strip_entities(nfkc(body) if normalise else body)))


def weekly_topics(schedule: Column, syllabus: Column) -> Column:
    """Topics of a schedule in cells between bars: after each cell that is a date such as 2/27, the next cell with text.

    Topics over 80 characters are dropped, and repeats after the first.
    """
    source = F.when(F.coalesce(schedule, F.lit("")) != "", schedule).otherwise(F.coalesce(syllabus, F.lit("")))
    cells = F.transform(F.split(source, r"\|"), strip)
    places = F.transform(cells, lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    filled = F.filter(places, lambda p: p["c"] != "")
    dates = F.filter(places, lambda p: p["c"].rlike(r"^\d+/\d+$"))
    after = F.transform(dates, lambda d: F.try_element_at(F.filter(filled, lambda p: p["i"] > d["i"]), F.lit(1))["c"])
    return F.array_distinct(F.filter(after, lambda c: c.isNotNull() & (F.length(c) <= 80)))


#: The characters of time slots, in order of hours from 6 on, and of weekdays from Monday on.
PERIODS = "AB1234CD5678EFGH"
WEEKDAYS = "一二三四五六日"
SESSION = "struct<weekday:int,start_hour:int,end_hour:int,raw:string>"


def time_slots(text: Column) -> Column:
    """Sessions of a string such as ``一23四56``: array of (weekday, start_hour, end_hour, raw).

    One fold over the characters.  A weekday opens a day; periods that follow each other merge; other
    characters are skipped.  Periods ahead of the first weekday run on into its day.
    """
    state = F.struct(
        F.array().cast(f"array<{SESSION}>").alias("out"), F.lit(0).alias("day"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit("").alias("marks")
    )

    def closed(s: Column) -> Column:
        item = F.struct(s["day"].alias("weekday"), (s["first"] + 6).alias("start_hour"), (s["last"] + 7).alias("end_hour"), F.concat(F.substring(F.lit(WEEKDAYS), s["day"], F.lit(1)), s["marks"]).alias("raw"))
        return F.when((s["day"] > 0) & (s["first"] >= 0), F.concat(s["out"], F.array(item))).otherwise(s["out"])

    def step(s: Column, c: Column) -> Column:
        day, period = F.instr(F.lit(WEEKDAYS), c), F.instr(F.lit(PERIODS), c) - 1
        ends = (s["day"] > 0) & (s["first"] >= 0)
        new_day = F.struct(closed(s).alias("out"), day.alias("day"), F.when(ends, -1).otherwise(s["first"]).alias("first"), F.when(ends, -1).otherwise(s["last"]).alias("last"), F.when(ends, "").otherwise(s["marks"]).alias("marks"))
        longer = F.struct(s["out"].alias("out"), s["day"].alias("day"), s["first"].alias("first"), period.alias("last"), F.concat(s["marks"], c).alias("marks"))
        opened = F.struct(F.when(s["first"] >= 0, closed(s)).otherwise(s["out"]).alias("out"), s["day"].alias("day"), period.alias("first"), period.alias("last"), c.alias("marks"))
        return F.when(day > 0, new_day).when(period < 0, s).when((s["first"] >= 0) & (period == s["last"] + 1), longer).otherwise(opened)

    body = F.coalesce(text, F.lit(""))
    characters = F.filter(F.split(body, ""), lambda c: c != "")
    return F.when(strip(body).isin("", "未定", "未定或彈性"), F.array().cast(f"array<{SESSION}>")).otherwise(F.aggregate(characters, state, step, closed))


def first_sentence(text: Column) -> Column:
    """The first sentence of 8 to 80 characters, or null."""
    parts = F.transform(F.split(text, r"[。！？!?\n]+"), strip)
    return F.try_element_at(F.filter(parts, lambda s: F.length(s).between(8, 80)), F.lit(1))


def query_key(text: Column) -> Column:
    """Comparison key of a query: no blanks, lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def query_id(prefix: str, source: Column, kind: Column, query: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws("|", source, kind, query)), 1, 8))


def cache_key(name: Column, model: Column, query: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", name, model, query), 256), 1, 16)


def row_key(model: Column, text: Column) -> Column:
    """Content key of one row of a cached table, such as an embedding."""
    return F.substring(F.sha2(F.concat(model, F.lit("\u0001"), text), 256), 1, 16)


def corpus_key(rows: DataFrame, model: str, text: str) -> DataFrame:
    """One row, key: the content key of a whole table of texts for one model, whatever the order of its rows."""
    number = F.conv(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    summed = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(number), F.lit(0).cast("decimal(38,0)")).alias("total"))
    return summed.select(F.substring(F.sha2(F.concat_ws("|", F.lit(model), "n", F.col("total").cast("decimal(38,0)").cast("string")), 256), 1, 16).alias("key"))


def first_json_object(text: Column) -> Column:
    """The text from the first opening to the last closing brace if that parses as JSON, else null."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    alone = F.try_parse_json(F.concat(F.lit("["), found, F.lit("]")))  # in brackets, for the parser stops after one value
    return F.when((found != "") & alone.isNotNull(), found)


def mentions_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def extract_patterns(text: Column, patterns: list[str]) -> Column:
    """Matches of several patterns in the patterns' order, of 8 to 50 characters, without repeats."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)) for p in patterns)))
    return F.array_distinct(F.filter(F.transform(found, strip), lambda s: F.length(s).between(8, 50)))


def with_query(passage: Column, query: Column) -> Column:
    """A passage for search, with the query put in front unless it is there."""
    return F.when(F.contains(passage, query), passage).otherwise(F.concat_ws("\n", query, passage))


def clean_variants(variants: Column, query: Column, most: int = 4) -> Column:
    """Rewritten queries: stripped, not empty, not the query itself, the first few."""
    return F.slice(F.filter(F.transform(variants, strip), lambda v: (v != "") & (v != query)), 1, most)


def strip_quotes(text: Column) -> Column:
    return F.regexp_replace(strip(text), "^[「」\"']+|[「」\"']+$", "")
