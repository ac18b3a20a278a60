"""Fusion, re-ranking and comparison of ranked lists (run, qid, doc_id, score, rank)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..sizes import small
from .lexical import Tokenizer, top_hits
from .pairs import PairModel, score_pairs

RRF_K = 60


def union_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """One table of several runs, with their names in ``run``."""
    out = None
    for name, hits in runs.items():
        part = hits.select(F.lit(name).alias("run"), "qid", "doc_id", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def rrf(runs: DataFrame, top_k: int = 20, k: int = RRF_K, weights: DataFrame | None = None, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Reciprocal-rank fusion: the sum of weight / (k + rank) over runs; a document that one run holds twice adds up.

    ``weights`` has run and weight, and any further columns of ``by`` that tell settings apart: a sweep is one plan.
    """
    weighted = runs.withColumn("weight", F.lit(1.0)) if weights is None else runs.join(F.broadcast(weights), "run")
    fused = weighted.groupBy(*by, "doc_id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"))
    return top_hits(fused.withColumn("list", F.struct(*by)), top_k, "list").select(*by, "doc_id", "score", "rank")


def overlap_score(query: Column, text: Column, tokenizer: Tokenizer = tokens) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the query's distinct tokens that the text holds."""
    wanted = F.array_distinct(tokenizer(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(wanted, tokenizer(text))), F.size(wanted)), F.lit(0.0))


def rerank(hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int, scorer: Callable[[Column, Column], Column] | PairModel = overlap_score, normalise: bool = False) -> DataFrame:
    """Scores every (query, document) pair of ``hits`` with ``scorer`` (a column of two columns, an Arrow UDF, or a model in Python) and ranks anew.

    ``normalise`` puts raw scores (logits) between 0 and 1 by a sigmoid.  The pairs are one table, so batches cross queries and
    balancing is Spark's.  Ties keep the order of the first ranking.
    """
    pairs = hits.select("qid", "doc_id", F.col("rank").alias("before")).join(queries.select("qid", F.col("text").alias("query")), "qid")
    pairs = docs.select("doc_id", "text").join(small(pairs), "doc_id")
    if isinstance(scorer, PairModel):
        pairs = score_pairs(pairs, scorer, "qid", "doc_id", "before")
    else:
        pairs = pairs.withColumn("score", scorer(F.col("query"), F.col("text")).cast("double"))
    if normalise:
        pairs = pairs.withColumn("score", 1 / (1 + F.exp(-F.col("score"))))
    order = Window.partitionBy("qid").orderBy(F.round("score", 8).desc(), "before")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "doc_id", "score", "rank")


def gold_ranks(qrels: DataFrame, legs: dict[str, DataFrame]) -> DataFrame:
    """For each (qid, doc_id) of gold: its best rank in each leg, named ``rank_<leg>``, null where it is missed."""
    best = qrels.select("qid").distinct()
    for name, hits in legs.items():
        ranks = hits.join(qrels, ["qid", "doc_id"]).groupBy("qid").agg(F.min("rank").alias(f"rank_{name}"))
        best = best.join(ranks, "qid", "left")
    return best
