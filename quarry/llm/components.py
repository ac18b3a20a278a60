"""Connected components of an edge table by alternating large-star and small-star steps.

Tasks first contract the edges that they hold to a forest of stars.  Then each step links a node's
neighbours to the smallest of them, so that paths and stars shrink to stars around the smallest
node of each component, and tasks contract again; it ends when all is stars.  Rounds are few shuffles of the
edges that are left, written to the shared folder; nothing but whether to go on reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the smallest node that each is connected with."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    top = np.arange(len(nodes))
    while True:
        i, j = top[left], top[right]
        open_ = i != j
        if not open_.any():
            return nodes, nodes[top]
        left, right, i, j = left[open_], right[open_], i[open_], j[open_]
        np.minimum.at(top, np.maximum(i, j), np.minimum(i, j))
        while (top != top[top]).any():
            top = top[top]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a > b that connect the same nodes: those of a partition become stars."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if held:
            nodes, tops = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            open_ = nodes != tops
            yield pa.RecordBatch.from_arrays([pa.array(nodes[open_]), pa.array(tops[open_])], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(contract, "a long, b long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a > b): new edges to the smallest neighbour of each node."""
    if large:  # every node looks at all its neighbours, and its larger ones go to the smallest
        sides = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("next")))
        least = sides.groupBy("node").agg(F.min("next").alias("least")).withColumn("least", F.least("node", "least"))
        moved = sides.join(stored(least, "least"), "node").where("next > node")  # a file: the join shuffles both sides, so Spark can split a hot node
        out = moved.select(F.col("next").alias("a"), F.col("least").alias("b"))
    else:  # every node looks at its smaller neighbours, and they and it go to the smallest
        least = stored(edges.groupBy("a").agg(F.min("b").alias("least")), "least")
        moved = edges.join(least, "a")
        out = moved.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
    return out.where("a > b")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """For each node of at least one edge between different nodes: node, component (the smallest node of its component)."""
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b")
    edges = stored(contracted(edges), "edges")
    while True:
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("up")).union(edges.select(F.col("b"), F.lit(None).cast("long")))
        seen = ends.groupBy("node").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.count_if(F.col("up").isNull()).alias("below"))
        if seen.where("low <> high or low is not null and below > 0").isEmpty():  # else a node has two above it, or one above and one below
            break
        once = stored(contracted(_star(edges, large=True)), "edges")
        after = stored(contracted(_star(once, large=False)), "edges")
        discard(edges, once)
        edges = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b"))).distinct()
