"""Scores of parsed conditions against gold conditions: 14 slots, 7 dimensions on 2 sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("course_lang", "weekday", "hour_range", "point", "kind", "lmt_kind", "unit")


def as_set(side: Column, dimension: str) -> Column:
    """A dimension's value as a set of strings; a scalar is a set of one, null is empty, and an hour range loses its order."""
    value = side[dimension]
    items = F.array_compact(F.array(value)) if dimension == "point" else value
    return F.array_distinct(F.coalesce(F.transform(items, lambda x: x.cast("string")), F.array().cast("array<string>")))


def slot_scores(rows: DataFrame) -> DataFrame:
    """Per id, side and dimension: tp, fp, fn, p, r, f1, of columns pred_must, pred_must_not, gold_must, gold_must_not. Both empty is right."""
    slots = [F.struct(F.lit(s).alias("side"), F.lit(d).alias("dimension"), as_set(F.col(f"pred_{s}"), d).alias("pred"), as_set(F.col(f"gold_{s}"), d).alias("gold")) for s in ("must", "must_not") for d in DIMENSIONS]
    each = rows.select("id", F.explode(F.array(*slots)).alias("slot")).select("id", "slot.*")
    each = each.withColumns({"tp": F.size(F.array_intersect("pred", "gold")), "fp": F.size(F.array_except("pred", "gold")), "fn": F.size(F.array_except("gold", "pred"))})
    none = (F.col("tp") + F.col("fp") + F.col("fn")) == 0
    ratio = lambda n, d: F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(n, d), F.lit(0.0)))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return each.select("id", "side", "dimension", "tp", "fp", "fn", ratio(tp, tp + fp).alias("p"), ratio(tp, tp + fn).alias("r"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def per_row(scores: DataFrame) -> DataFrame:
    """Per id: slot_f1 (mean of 14), exact_match, and neg_p, neg_r, neg_f1, pooled over the dimensions of must_not (nothing there gives 0)."""
    neg = lambda c: F.sum(F.when(F.col("side") == "must_not", F.col(c)).otherwise(0))
    sums = scores.groupBy("id").agg(F.avg("f1").alias("slot_f1"), F.bool_and((F.col("fp") == 0) & (F.col("fn") == 0)).alias("exact_match"), neg("tp").alias("tp"), neg("fp").alias("fp"), neg("fn").alias("fn"))
    ratio = lambda n, d: F.coalesce(F.try_divide(n, d), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("id", "slot_f1", "exact_match", ratio(tp, tp + fp).alias("neg_p"), ratio(tp, tp + fn).alias("neg_r"), ratio(2 * tp, 2 * tp + fp + fn).alias("neg_f1"))


def summarise(scores: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: n, exact_match, overall_slot_f1 (mean of the rounded dimensions), negation_f1 and negation_n (rows with has_negation)."""
    dims = scores.groupBy("dimension").agg(F.round(F.avg("f1"), 4).alias("f1")).agg(F.round(F.avg("f1"), 4).alias("overall_slot_f1"))
    each = per_row(scores).join(rows.select("id", "has_negation"), "id")
    total = each.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("exact_match").cast("double")), 4).alias("exact_match"),
        F.round(F.coalesce(F.avg(F.when(F.col("has_negation"), F.col("neg_f1"))), F.lit(0.0)), 4).alias("negation_f1"), F.count_if("has_negation").alias("negation_n"),
    )
    return total.crossJoin(dims)


def aggregate_metrics(scores: DataFrame) -> DataFrame:
    """One row of means over rows: n, slot_f1, exact_match, neg_p, neg_r, neg_f1."""
    return per_row(scores).agg(F.count(F.lit(1)).alias("n"), F.avg("slot_f1").alias("slot_f1"), F.avg(F.col("exact_match").cast("double")).alias("exact_match"), *(F.avg(c).alias(c) for c in ("neg_p", "neg_r", "neg_f1")))
