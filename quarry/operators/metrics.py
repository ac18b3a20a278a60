"""Retrieval metrics of hits (qid, doc_id, rank) against gold (qid, doc_id).  Queries without hits or gold stay in the means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTS = (5, 10, 20)


def per_query(queries: DataFrame, hits: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """qid, k, n_gold, recall, hit, mrr, ndcg (binary gain, log2(rank + 1), ideal over min(gold, k))."""
    gold = qrels.select("qid", "doc_id").distinct()
    sizes = gold.groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"))
    found = hits.join(gold, ["qid", "doc_id"]).groupBy("qid").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    base = queries.select("qid").distinct().join(sizes, "qid", "left").join(found, "qid", "left").fillna({"n_gold": 0})
    base = base.withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>"))).withColumn("k", F.explode(F.array(*map(F.lit, cuts))))
    inside = F.expr("filter(ranks, r -> r <= k)")
    gain = F.expr("aggregate(filter(ranks, r -> r <= k), 0D, (s, r) -> s + 1 / log2(r + 1))")
    ideal = F.expr("aggregate(sequence(1, cast(greatest(least(n_gold, k), 1) as int)), 0D, (s, i) -> s + 1 / log2(i + 1))")
    none = F.col("n_gold") == 0
    return base.select(
        "qid", "k", "n_gold",
        F.when(none, 0.0).otherwise(F.size(inside) / F.col("n_gold")).alias("recall"),
        (F.size(inside) > 0).cast("double").alias("hit"),
        F.coalesce(1 / F.try_element_at(inside, F.lit(1)), F.lit(0.0)).alias("mrr"),
        F.when(none, 0.0).otherwise(gain / ideal).alias("ndcg"),
    )


def macro(per: DataFrame, *by: str) -> DataFrame:
    """Means over queries for each k, and n; no rows for no queries."""
    names = ("recall", "hit", "mrr", "ndcg")
    return per.groupBy("k", *by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(m) for m in names))


def compare_runs(a: DataFrame, b: DataFrame, slices: DataFrame, metric: str = "hit", k: int = 10) -> DataFrame:
    """Overall and by slice (null for all): n, the metric of both runs and their difference in points."""
    sides = a.where(F.col("k") == k).select("qid", F.col(metric).alias("a")).join(b.where(F.col("k") == k).select("qid", F.col(metric).alias("b")), "qid").join(slices, "qid")
    sides = sides.groupingSets([[], ["slice"]], "slice")
    return sides.agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("a"), F.avg("b").alias("b"), ((F.avg("b") - F.avg("a")) * 100).alias("points"))


def first_misses(hits: DataFrame, queries: DataFrame, qrels: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` of ``queries`` (qid, ...) of whose gold no document was found."""
    found = hits.join(qrels, ["qid", "doc_id"], "left_semi").select("qid")
    return queries.join(found, "qid", "left_anti").orderBy("qid").limit(n)


def report_lines(configs: DataFrame, results: DataFrame) -> DataFrame:
    """A report as Markdown, a row a line: configs (position, label, run) in order, with their results (run, n, recall, ndcg, mrr, ms) or dashes; the best recall is named last."""
    both = configs.join(results, "run", "left")
    dash = F.lit("—")
    cell = lambda c, form: F.when(F.col("n").isNull(), dash).otherwise(F.format_string(form, c))
    cells = ["label", F.when(F.col("n").isNull(), dash).otherwise(F.col("n").cast("string")), *(cell(F.col(c).cast("double"), "%.3f") for c in ("recall", "ndcg", "mrr")), cell(F.col("ms").cast("double"), "%.0fms")]
    lines = both.select("position", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    best = both.where("n is not null").agg(F.max_by(F.struct("label", "recall"), F.struct("recall", -F.col("position"))).alias("best"))
    last = best.select(F.lit(1 << 30).alias("position"), F.concat(F.lit("best: "), F.coalesce("best.label", dash), F.lit(", R@10="), F.format_string("%.3f", F.coalesce(F.col("best.recall").cast("double"), F.lit(0.0)))).alias("line"))
    return lines.unionByName(last)
