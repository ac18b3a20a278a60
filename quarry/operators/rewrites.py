"""Rewritten queries from a cache: how many each mode searches, and what stands in where the cache has none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cache_key, clean_variants, row_key, strip_quotes
from . import lexical, rank

#: Most queries of a mode; more numbers than any mode uses, so that (qid, number) fits one integer.
MOST_QUERIES = 8


def _texts(mode: str, query: Column, cached: Column) -> Column:
    """The queries that a mode searches, of a query and its cached rewrites (an array, or null where there are none)."""
    first = F.try_element_at(cached, F.lit(1))
    match mode:
        case "raw":
            return F.array(query)
        case "hyde":  # a made-up document instead of the query
            return F.array(F.coalesce(first, query))
        case "q2d":  # a passage that names the query
            return F.array(F.when(first.isNull(), query).when(F.contains(first, query), first).otherwise(F.concat(query, F.lit("。"), first)))
        case "stepback":  # the query and the wider term
            wider = F.nullif(strip_quotes(first), F.lit(""))
            return F.array_compact(F.array(query, wider))
        case "multi":  # the query and up to four paraphrases
            return F.concat(F.array(query), F.coalesce(clean_variants(cached, query), F.array().cast("array<string>")))
    raise ValueError(f"unknown mode {mode!r}")


def fan_out(queries: DataFrame, cache: DataFrame, mode: str, model: str = "") -> DataFrame:
    """qid, number (from 0), text: the queries that ``mode`` searches for each of ``queries`` (qid, text).

    ``cache`` has key (of mode, model and query) and texts (an array).  A query that it lacks is searched as it is.
    """
    keyed = queries.withColumn("key", cache_key(F.lit(mode), F.lit(model), F.col("text")))
    found = keyed.join(cache.select("key", F.col("texts").alias("cached")).dropDuplicates(["key"]), "key", "left")
    return found.select("qid", F.posexplode(_texts(mode, F.col("text"), F.col("cached"))).alias("number", "text"))


def search_fan_out(forms: DataFrame, index: lexical.Index, retrieve_k: int = 20) -> DataFrame:
    """qid, doc_id, score, rank: all forms are searched in one plan, and the hits of a query's forms are fused."""
    numbered = forms.select((F.col("qid") * MOST_QUERIES + F.col("number")).alias("qid"), "text")
    hits = lexical.bm25_search(numbered, index, retrieve_k)
    runs = hits.select(F.pmod("qid", F.lit(MOST_QUERIES)).cast("string").alias("run"), F.floor(F.col("qid") / MOST_QUERIES).alias("qid"), "doc_id", "score", "rank")
    return rank.rrf(runs, retrieve_k)


def encode_cached(rows: DataFrame, cache: DataFrame, encoder: Callable[[DataFrame], DataFrame], model: str) -> DataFrame:
    """key, vector for the texts of ``rows`` (text): cached ones (key, vector) as they are, others by the encoder.

    The encoder takes (key, text) and gives (key, vector); each different text reaches it once.  Write the
    result as the next cache.
    """
    wanted = rows.select(row_key(F.lit(model), F.col("text")).alias("key"), "text").groupBy("key").agg(F.any_value("text").alias("text"))
    known = cache.select("key", "vector").join(wanted.select("key"), "key", "left_semi")
    return known.unionByName(encoder(wanted.join(cache.select("key"), "key", "left_anti")).select("key", "vector"))
