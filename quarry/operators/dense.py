"""Exact vector search: blocks of queries against blocks of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import top_hits

#: Rows of a block of queries and of documents; with a pool, a pair of blocks must hold all its (query, document) pairs too.
QUERY_BLOCK, DOC_BLOCK = 8192, 20_000
POOL_QUERY_BLOCK, POOL_DOC_BLOCK = 1024, 4096
#: Queries of one matrix product.
STEP = 256


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = 10, exclude_self: bool = False, allowed: DataFrame | None = None) -> DataFrame:
    """qid, doc_id, score, rank: the k largest dot products of ``queries`` (qid, vector) with ``vectors`` (doc_id, vector).

    Both sides are dealt into blocks by hash, and each pair of blocks is one group: a few matrix products, of
    which the k best a query leave the task.  ``allowed`` (qid, doc_id) is dealt likewise, and masks the
    products before the cut.  Nothing has a floor or a cap but k, and nothing passes through the driver but two counts.
    """
    per_query, per_doc = (QUERY_BLOCK, DOC_BLOCK) if allowed is None else (POOL_QUERY_BLOCK, POOL_DOC_BLOCK)
    n_queries, n_docs = (max(1, -(-df.count() // size)) for df, size in ((queries, per_query), (vectors, per_doc)))
    of_query = F.pmod(F.xxhash64("qid"), F.lit(n_queries)).cast("int")
    of_doc = F.pmod(F.xxhash64("doc_id"), F.lit(n_docs)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("long")
    asked = queries.select(of_query.alias("qb"), every(n_docs).alias("db"), F.col("qid").cast("long").alias("qid"), none.alias("doc_id"), F.col("vector").cast("array<double>").alias("vector"))
    stored = vectors.select(every(n_queries).alias("qb"), of_doc.alias("db"), none.alias("qid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("vector").cast("array<double>").alias("vector"))
    rows = asked.unionByName(stored)
    if allowed is not None:
        rows = rows.unionByName(allowed.select(of_query.alias("qb"), of_doc.alias("db"), F.col("qid").cast("long").alias("qid"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("array<double>").alias("vector")))

    masked = allowed is not None

    def multiply(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        has_q, has_d = (table.column(c).is_valid().to_numpy() for c in ("qid", "doc_id"))

        def side(mask: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
            rows = table.filter(pa.array(mask))
            ids = rows.column(name).to_numpy()
            return ids, rows.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)

        if not (has_q & ~has_d).any() or not (has_d & ~has_q).any():
            return
        qids, left = side(has_q & ~has_d, "qid")
        ids, right = side(has_d & ~has_q, "doc_id")
        pairs = table.filter(pa.array(has_q & has_d))
        order_q, order_d = np.argsort(qids, kind="stable"), np.argsort(ids, kind="stable")
        qids, left, ids, right = qids[order_q], left[order_q], ids[order_d], right[order_d]
        for begin in range(0, len(qids), STEP):
            some = qids[begin : begin + STEP]
            scores = left[begin : begin + STEP] @ right.T
            if masked:
                mask = np.zeros(scores.shape, dtype=bool)
                pq, pd = pairs.column("qid").to_numpy(), pairs.column("doc_id").to_numpy()
                inside = (pq >= some[0]) & (pq <= some[-1])
                pq, pd = pq[inside], pd[inside]
                known = np.isin(pq, some) & np.isin(pd, ids)
                pq, pd = pq[known], pd[known]
                for i in range(int(np.bincount(np.unique(qids, return_inverse=True)[1]).max())):  # an id may stand on several rows
                    for j in range(int(np.bincount(np.unique(ids, return_inverse=True)[1]).max())):
                        q, d = np.searchsorted(some, pq) + i, np.searchsorted(ids, pd) + j
                        q, d = np.minimum(q, len(some) - 1), np.minimum(d, len(ids) - 1)
                        same = (some[q] == pq) & (ids[d] == pd)
                        mask[q[same], d[same]] = True
                scores[~mask] = -np.inf
            if exclude_self:
                scores[some[:, None] == ids[None, :]] = -np.inf
            if scores.shape[1] > k + 1:
                rounded = np.round(scores, 8)
                floor = np.partition(rounded, -k, axis=1)[:, -k][:, None]
                q, d = np.nonzero((rounded >= floor) & (scores > -np.inf))  # ties at the border stay for the final ranking
            else:
                q, d = np.nonzero(scores > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(some[q]), pa.array(ids[d]), pa.array(scores[q, d])], names=["qid", "doc_id", "score"])

    found = rows.groupBy("qb", "db").applyInArrow(multiply, "qid long, doc_id long, score double")
    return top_hits(found, k).select("qid", "doc_id", "score", "rank")
