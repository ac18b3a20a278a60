"""Stored vectors in blocks with a centre and a radius: exact search that reads only blocks whose bound is good enough.

For a vector x of a block with centre c and radius r, and a query q, q.x = q.c + q.(x - c) <= q.c + |q| r.  A search scores the
most promising blocks first; a block whose bound stays below the k-th best score so far is never read.  How many
blocks that spares depends on how well the vectors cluster; the result doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path, stored
from ..sizes import small
from .lexical import SCORE_PLACES, top_hits

#: Vectors of a block; queries of one matrix product; headers of one bound product.
BLOCK, CHUNK, HEADERS = 128, 256, 4096
#: Centres are fitted on at most this many vectors, those of the least hashes; every vector is assigned to one.
FITTED, CENTRES = 20_000, 256
#: Chunks of queries that are broadcast; more are met by a plain product.
BROADCAST_CHUNKS = 500
#: Blocks a query that are scored before there is a k-th best score.
PROBED = 4
_STORED = "block long, ids array<long>, vectors array<double>, centre array<double>, radius double"


@dataclass(frozen=True)
class VectorBlocks:
    """block, ids, vectors (one after the other), centre, radius: a row a block, below ``path``."""

    path: str
    blocks: DataFrame

    @property
    def vectors(self) -> DataFrame:
        """doc_id, vector of all stored rows."""
        place = F.posexplode("ids").alias("slot", "doc_id")
        rows = self.blocks.select("vectors", F.size("centre").alias("width"), place)
        return rows.select("doc_id", F.slice("vectors", F.col("slot") * F.col("width") + 1, F.col("width")).alias("vector"))


def _clustered(rows: DataFrame) -> DataFrame:
    """Rows with the number of their nearest centre; a small table is one cluster."""
    seen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FITTED)
    n = seen.count()
    k = min(CENTRES, n // BLOCK)
    if k < 2:
        return rows.withColumn("cluster", F.lit(0))
    features = array_to_vector("vector")
    model = KMeans(k=k, seed=1, maxIter=10, initSteps=1, featuresCol="features", predictionCol="cluster").fit(seen.select(features.alias("features")))
    return model.transform(rows.withColumn("features", features)).drop("features")


def write_blocks(vectors: DataFrame, path: str | None = None) -> VectorBlocks:
    """Stores ``vectors`` (doc_id, vector, all of one length) in blocks below ``path`` (the shared scratch space by default).

    Rows are sorted by cluster and cut every ``BLOCK`` rows, so a cluster with a third of all vectors is many blocks of many
    tasks.  Rows without id or vector are left out; an id may stand on several rows.
    """
    spark = vectors.sparkSession
    path = path or scratch_path(spark, "vector-blocks")
    rows = vectors.where("doc_id is not null and vector is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vector").cast("array<double>").alias("vector"))
    lined = _clustered(rows).repartitionByRange("cluster", F.xxhash64("doc_id"), "doc_id").sortWithinPartitions("cluster", F.xxhash64("doc_id"), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, points, clusters = np.empty(0, np.int64), None, np.empty(0, np.int64)
        for batch in _and_end(batches):
            if batch is not None and batch.num_rows:
                more = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)
                ids, clusters = np.concatenate([ids, batch.column("doc_id").to_numpy()]), np.concatenate([clusters, batch.column("cluster").to_numpy()])
                points = more if points is None else np.concatenate([points, more])
            begin, made = 0, []
            while begin < len(ids):
                end = begin + int(np.searchsorted(clusters[begin : begin + BLOCK], clusters[begin], side="right"))
                if end == len(ids) and batch is not None and end - begin < BLOCK:
                    break  # the next batch may go on with it
                part = points[begin:end]
                centre = part.mean(axis=0)
                made.append((number, ids[begin:end], part.ravel(), centre, float(np.sqrt(((part - centre) ** 2).sum(axis=1).max()))))
                number, begin = number + 1, end
            ids, clusters, points = ids[begin:], clusters[begin:], points[begin:] if points is not None else None
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names=["block", "ids", "vectors", "centre", "radius"])

    lined.select("doc_id", "vector", F.col("cluster").cast("long").alias("cluster")).mapInArrow(cut, _STORED).write.option("compression", "zstd").parquet(path)
    return read_blocks(spark, path)


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, and None after the last."""
    yield from batches
    yield None


def read_blocks(spark: SparkSession, path: str) -> VectorBlocks:
    return VectorBlocks(path, spark.read.schema(_STORED).parquet(path))


def _rows(lists: pa.ListArray, i: int) -> pa.StructArray:
    return lists.slice(i, 1).flatten()


def _column(rows: pa.StructArray, name: str) -> pa.Array:
    return rows.flatten()[rows.type.get_field_index(name)]


def _numbers(rows: pa.StructArray, name: str) -> np.ndarray:
    return _column(rows, name).to_numpy(zero_copy_only=False)


def _matrix(rows: pa.StructArray, name: str) -> np.ndarray:
    return _column(rows, name).flatten().to_numpy().reshape(len(rows), -1)


def _chunked(queries: DataFrame, n: int, *by: str, extra: tuple[Column, ...] = ()) -> DataFrame:
    part = F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-n // CHUNK))))
    return queries.groupBy(*by, part.alias("part")).agg(F.collect_list(F.struct("qid", "vector", "floor", *extra)).alias("asked"))


def _promising(queries: DataFrame, n: int, blocks: VectorBlocks, most: int | None) -> DataFrame:
    """qid, block, bound: the ``most`` best bounds of each group of headers, or all bounds that reach the query's floor."""
    # headers alone: the scan reads no vectors
    headers = blocks.blocks.select(F.struct("block", "centre", "radius").alias("header"), F.spark_partition_id().alias("at"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("nth"))
    packed = headers.groupBy("at", F.floor(F.col("nth") / HEADERS).alias("group")).agg(F.collect_list("header").alias("headers")).select("headers")
    # a stated set of queries against all headers, in blocks
    met = packed.crossJoin(_chunked(queries, n).select("asked"))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, headers = _rows(batch.column("asked"), i), _rows(batch.column("headers"), i)
                left, qids, floor = _matrix(asked, "vector"), _numbers(asked, "qid"), _numbers(asked, "floor")
                bound = left @ _matrix(headers, "centre").T + np.sqrt((left**2).sum(axis=1))[:, None] * _numbers(headers, "radius")[None, :]
                if most is None:
                    q, b = np.nonzero(bound >= floor[:, None])
                else:
                    some = min(most, bound.shape[1])
                    b = np.argpartition(-bound, some - 1, axis=1)[:, :some].ravel()
                    q = np.repeat(np.arange(len(qids)), some)
                yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(_numbers(headers, "block")[b]), pa.array(bound[q, b])], names=["qid", "block", "bound"])

    return met.mapInArrow(bounds, "qid long, block long, bound double")


def _score(pairs: DataFrame, queries: DataFrame, n: int, blocks: VectorBlocks, k: int, exclude_self: bool, pooled: bool) -> DataFrame:
    """qid, doc_id, score: of each (qid, block) of ``pairs`` what may be among the k best; blocks that nobody asks for aren't joined."""
    asked = _chunked(pairs.join(small(queries), "qid"), n, "block", extra=(F.col("slots"),) if pooled else ())
    # never broadcast: rows are few, but hold the vectors of all queries that ask for a block
    met = blocks.blocks.select("block", "ids", "vectors").join(asked, "block").select("ids", "vectors", "asked")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, ids = _rows(batch.column("asked"), i), batch.column("ids").slice(i, 1).flatten().to_numpy()
                qids, floor = _numbers(asked, "qid"), _numbers(asked, "floor")
                scores = _matrix(asked, "vector") @ batch.column("vectors").slice(i, 1).flatten().to_numpy().reshape(len(ids), -1).T
                if pooled:
                    slots = _column(asked, "slots")
                    open_ = np.zeros(scores.shape, dtype=bool)
                    open_[np.repeat(np.arange(len(qids)), slots.value_lengths().to_numpy()), slots.flatten().to_numpy()] = True
                    scores[~open_] = -np.inf
                if exclude_self:
                    scores[qids[:, None] == ids[None, :]] = -np.inf
                rounded = np.round(scores, SCORE_PLACES)
                least = np.round(floor, SCORE_PLACES)
                if scores.shape[1] > k:
                    least = np.maximum(least, np.partition(rounded, -k, axis=1)[:, -k])
                q, d = np.nonzero((rounded >= least[:, None]) & (scores > -np.inf))  # ties at the border stay for the final ranking
                yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(ids[d]), pa.array(scores[q, d])], names=["qid", "doc_id", "score"])

    return met.mapInArrow(multiply, "qid long, doc_id long, score double")


def _swept(queries: DataFrame, n: int, blocks: VectorBlocks, k: int, exclude_self: bool) -> DataFrame:
    """qid, doc_id, score: what may be among the k best of each query (with its floor), from all blocks whose bound reaches it.

    The queries go to the blocks, so pairs of queries and blocks are rows nowhere; a task raises the floors as it goes.
    """
    chunks = _chunked(queries, n)
    met = blocks.blocks.crossJoin(small(chunks, BROADCAST_CHUNKS)).select("ids", "vectors", "centre", "radius", "part", "asked")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_of: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                part = batch.column("part")[i].as_py()
                if part not in chunk_of:
                    asked = _rows(batch.column("asked"), i)
                    left, floor = _matrix(asked, "vector").copy(), _numbers(asked, "floor").copy()
                    chunk_of[part] = left, np.sqrt((left**2).sum(axis=1)), _numbers(asked, "qid").copy(), floor, np.full((len(floor), k), -np.inf)
                left, norm, qids, floor, tops = chunk_of[part]
                centre = batch.column("centre").slice(i, 1).flatten().to_numpy()
                live = np.flatnonzero(left @ centre + norm * batch.column("radius")[i].as_py() >= floor)
                if not len(live):
                    continue
                ids = batch.column("ids").slice(i, 1).flatten().to_numpy()
                scores = left[live] @ batch.column("vectors").slice(i, 1).flatten().to_numpy().reshape(len(ids), -1).T
                if exclude_self:
                    scores[qids[live][:, None] == ids[None, :]] = -np.inf
                tops[live] = np.partition(np.concatenate([tops[live], scores], axis=1), -k, axis=1)[:, -k:]
                floor[live] = np.maximum(floor[live], tops[live].min(axis=1) - 1e-6)
                q, d = np.nonzero((scores >= floor[live][:, None]) & (scores > -np.inf))  # ties at the border stay for the final ranking
                found.append((qids[live][q], ids[d], scores[q, d]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["qid", "doc_id", "score"])

    return met.mapInArrow(multiply, "qid long, doc_id long, score double")


@dataclass(frozen=True)
class BlockSearch:
    """Hits (qid, doc_id, score, rank) of a search and the (qid, block) that were scored for them."""

    hits: DataFrame
    read: DataFrame


def search_blocks(queries: DataFrame, blocks: VectorBlocks, k: int = 10, exclude_self: bool = False, allowed: DataFrame | None = None, probed: int = PROBED) -> BlockSearch:
    """The k largest dot products of each query (qid, vector), qid being unique; exact, with ties by doc_id.

    ``allowed`` (qid, doc_id) restricts each query to its rows; then only blocks that hold one of them count.  Queries without
    id or vector find nothing.
    """
    asked = queries.where("qid is not null and vector is not null").select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("vector"))
    asked = stored(asked, "asked")
    n, open_ = asked.count(), F.lit(float("-inf"))
    start = asked.withColumn("floor", open_)
    slots = None
    if allowed is not None:
        places = blocks.blocks.select("block", F.posexplode("ids").alias("slot", "doc_id"))
        slots = stored(places.join(small(allowed.select(F.col("qid").cast("long").alias("qid"), "doc_id").distinct()), "doc_id").groupBy("qid", "block").agg(F.collect_list("slot").alias("slots")), "slots")
        bounds = slots.join(blocks.blocks.select("block", "centre", "radius"), "block").join(small(asked), "qid")
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        bounds = bounds.select("qid", "block", (dot(F.col("vector"), F.col("centre")) + F.sqrt(dot(F.col("vector"), F.col("vector"))) * F.col("radius")).alias("bound"))
        bounds = stored(bounds, "bounds")
    else:
        bounds = _promising(start, n, blocks, probed)
    order = Window.partitionBy("qid").orderBy(F.desc("bound"), "block")
    first = stored(bounds.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= probed + k // BLOCK).select("qid", "block"), "first")
    with_slots = (lambda pairs: pairs.join(slots, ["qid", "block"])) if slots is not None else (lambda pairs: pairs)
    best = stored(top_hits(_score(with_slots(first), start, n, blocks, k, exclude_self, slots is not None), k), "best")
    floor = best.where(F.col("rank") == k).select("qid", (F.round("score", SCORE_PLACES) - 1e-6).alias("floor"))
    later = stored(asked.join(small(floor), "qid", "left").select("qid", "vector", F.coalesce("floor", open_).alias("floor")), "later")
    if slots is None:
        rest = _promising(later, n, blocks, None).select("qid", "block").join(small(first), ["qid", "block"], "left_anti")  # made only where it is asked for
        both = _swept(later, n, blocks, k, exclude_self)  # the first blocks again, since their bounds reach the floor too
    else:
        reach = bounds.join(small(later.select("qid", "floor")), "qid").where("bound >= floor")
        rest = stored(reach.select("qid", "block").join(small(first), ["qid", "block"], "left_anti"), "rest")
        both = best.drop("rank").unionByName(_score(with_slots(rest), later, n, blocks, k, exclude_self, True))
    return BlockSearch(top_hits(both, k).select("qid", "doc_id", "score", "rank"), first.unionByName(rest))
