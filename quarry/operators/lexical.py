"""BM25 as joins: an index of postings in blocks of documents, searched by a batch of queries in one plan.

Documents are lined up by their most frequent term and their length, which puts texts of one language and
size together, and every 64 of them form a block.  The index has a row a term and block: the highest frequency and
the least length in it, and the postings.  The first two bound what the term can add to any score in the block.

A block's postings are made where its documents are, so nothing but the documents' terms is shuffled for an index.

A search sums up bounds first, scores the most promising blocks, and then only those whose bound reaches the k-th best score so far.
The result is that of scoring everything.  A block is scored for all queries at once, as a product of their weights and its postings, and
only documents that may be among the k best leave its task.

A set of documents is a 64-bit mask a block: pools of allowed documents, and deletion marks, are tested bit by bit.

An index is a folder of segments.  A batch of new documents becomes a segment of its own; documents that it replaces, or that are
removed, are marked, and no segment is written again.  Statistics count what is live, so that a search gives what a rebuilt index gives.
Document ids are unique within a batch (repeated ones are ranked as documents of their own).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let, tokens
from ..session import scratch_path, stored
from ..sizes import small

K1, B, EPSILON = 1.5, 0.75, 0.25
SCORE_PLACES = 8
#: Documents of one most frequent term are spread over so many classes.
SPREADS = 64
BLOCK_BITS = 6
#: Blocks that a query scores before it has a k-th best score.
PROBED = 8
#: Blocks whose postings are sorted at a time; queries of one matrix product.
SORTED, STEP = 16, 512
#: What rounding may change in a score.
SLACK = 1e-7
#: Segment numbers stand above the block numbers of a segment.
SEGMENT_BITS = 40
Tokenizer = Callable[[Column], Column]


def _runs(docs: DataFrame, doc: str, text: str, tokenizer: Tokenizer) -> DataFrame:
    """doc_id, dl and runs (term, tf): a document's terms are sorted and counted where the document is."""

    def counted(words: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))
        starts = F.filter(places, lambda i: (i < F.size(words)) & ((i == 0) | (F.get(words, i) != F.get(words, i - 1))))
        return let(starts, lambda s: F.zip_with(s, F.slice(F.concat(s, F.array(F.size(words))), F.lit(2), F.size(s)), lambda a, b: F.struct(F.get(words, a).alias("term"), (b - a).cast("long").alias("tf"))))

    made = docs.select(F.col(doc).alias("doc_id"), let(F.sort_array(tokenizer(F.col(text))), counted).alias("runs"))
    return made.select("doc_id", F.aggregate("runs", F.lit(0), lambda n, r: n + r["tf"].cast("int")).alias("dl"), "runs")


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text", tokenizer: Tokenizer = tokens) -> DataFrame:
    """doc_id, term, tf, dl (the document's tokens), a row for each different term of each row of ``docs``; nothing is shuffled."""
    return _runs(docs, doc, text, tokenizer).select("doc_id", "dl", F.inline("runs")).select("doc_id", "term", "tf", "dl")


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl of documents (dl); those without tokens count with length 0."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.try_divide(F.sum("dl"), F.count(F.lit(1))).alias("avgdl"))


def term_weights(df: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf from document frequencies; a negative idf becomes a share of the mean over all terms before replacement."""
    raw = df.crossJoin(F.broadcast(stats)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


@dataclass(frozen=True)
class Index:
    """Tables of an index.

    docs: doc_id, block, slot, dl.  blocks: term, block, n, most_tf, least_dl, hits (slot, doc_id, tf, dl).  dead: block and the bits
    of its deleted documents, or None.  stats: one row.  weights: term, df, idf.  The tokenizer is the one that queries need too.
    """

    path: str
    docs: DataFrame
    blocks: DataFrame
    dead: DataFrame | None
    stats: DataFrame
    weights: DataFrame
    tokenizer: Tokenizer = field(default=tokens)

    @property
    def postings(self) -> DataFrame:
        """doc_id, term, tf, dl of all live documents."""
        return self.postings_of()

    def postings_of(self, terms: DataFrame | None = None) -> DataFrame:
        """The postings of a table of terms (term); other rows are dropped before they are written out."""
        blocks = self.blocks if terms is None else self.blocks.join(small(terms.select("term").distinct()), "term", "left_semi")
        return _live(blocks.select("term", "block", F.inline("hits")), self.dead).select("doc_id", "term", "tf", "dl")


def bit(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), slot)


def has_bit(bits: Column, slot: Column) -> Column:
    return F.call_function("shiftrightunsigned", bits, slot).bitwiseAND(F.lit(1).cast("long")) == 1


def _live(rows: DataFrame, dead: DataFrame | None) -> DataFrame:
    """Rows (block, slot, ...) without those of deleted documents."""
    if dead is None:
        return rows
    marked = rows.join(small(dead.withColumnRenamed("bits", "dead_bits")), "block", "left")
    return marked.where(~F.coalesce(has_bit(F.col("dead_bits"), F.col("slot")), F.lit(False))).drop("dead_bits")


def _cut(joined: pa.StringArray, sizes: pa.ListArray) -> pa.StringArray:
    """The terms of all rows, one after the other, from each row's terms joined without a separator and their sizes in bytes."""
    _, offsets, data = joined.buffers()
    first = np.frombuffer(offsets, np.int32)[joined.offset] if len(joined) else 0
    ends = first + np.cumsum(sizes.flatten().to_numpy(), dtype=np.int64)
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate([[first], ends]).astype(np.int32)), data or pa.py_buffer(b""))


def _block_rows(lined: pa.Table) -> Iterator[pa.RecordBatch]:
    """A row a term and block of whole blocks of documents (block, slot, doc_id, dl, terms, sizes, tfs); a block's first row has its documents too."""
    numbers = lined.column("block").to_numpy()
    begins = np.flatnonzero(np.diff(numbers, prepend=-1))
    for first in range(0, len(begins), SORTED):
        low, high = begins[first], begins[first + SORTED] if first + SORTED < len(begins) else len(numbers)
        part = lined.slice(low, high - low).combine_chunks()
        columns = {c: part.column(c).combine_chunks() for c in part.column_names}
        terms = _cut(columns["terms"], columns["sizes"]).dictionary_encode()
        row = np.repeat(np.arange(high - low), columns["sizes"].value_lengths().to_numpy())
        block = np.searchsorted(begins[first : first + SORTED] - low, np.arange(high - low), side="right") - 1
        n_terms = max(1, len(terms.dictionary))
        key = block[row] * n_terms + terms.indices.to_numpy()
        # blocks without terms have a row too
        bare = np.setdiff1d(np.arange(block[-1] + 1), block[row])
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        tf, dl = columns["tfs"].flatten().to_numpy()[order].astype(np.int64), columns["dl"].to_numpy()
        places = pa.array(row)
        hits = pa.StructArray.from_arrays([columns["slot"].take(places), columns["doc_id"].take(places), pa.array(tf), pa.array(dl[row])], names=["slot", "doc_id", "tf", "dl"])
        of_block = np.concatenate([key[starts] // n_terms, bare])
        none = np.zeros(len(bare), np.int64)
        most = np.concatenate([np.maximum.reduceat(tf, starts) if len(starts) else none[:0], none])
        least = np.concatenate([np.minimum.reduceat(dl[row], starts) if len(starts) else none[:0], none]).astype(np.int32)
        ends = np.concatenate([starts, np.full(len(bare) + 1, len(row))])
        names = pa.concat_arrays([terms.dictionary.take(pa.array(key[starts] % n_terms)), pa.nulls(len(bare), terms.dictionary.type)])
        # documents stand on the first row of their block
        heads = np.flatnonzero(np.diff(of_block, prepend=-1))
        heads = heads[np.argsort(of_block[heads])]
        counts = np.zeros(len(of_block), np.int64)
        counts[heads] = np.diff(np.append(begins[first : first + SORTED] - low, high - low))
        docs = pa.StructArray.from_arrays([columns["slot"], columns["doc_id"], columns["dl"]], names=["slot", "doc_id", "dl"])
        if len(bare):  # documents in the order of the rows that have them
            at = np.flatnonzero(counts)
            firsts = begins[first : first + SORTED] - low
            docs = docs.take(pa.array(np.concatenate([np.arange(firsts[of_block[i]], firsts[of_block[i]] + counts[i]) for i in at])))
        members = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), docs)
        yield pa.RecordBatch.from_arrays(
            [names, columns["block"].take(pa.array(np.searchsorted(block, of_block))), pa.array(np.diff(ends)), pa.array(most), pa.array(least), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), hits), members],
            names=["term", "block", "n", "most_tf", "least_dl", "hits", "members"],
        )


def _write_segment(docs: DataFrame, path: str, number: int, doc: str, text: str, tokenizer: Tokenizer) -> None:
    runs = _runs(docs, doc, text, tokenizer)
    lead = F.coalesce(F.array_max(F.transform("runs", lambda r: F.struct(r["tf"], r["term"])))["term"], F.lit(""))
    # terms are shuffled as one string a document: an array of strings takes 8 bytes more for each, and pads it
    joined, sizes = F.coalesce(F.array_join("runs.term", ""), F.lit("")), F.transform("runs", lambda r: F.octet_length(r["term"]))
    lists = runs.select("doc_id", F.col("dl").cast("int").alias("dl"), lead.alias("lead"), joined.alias("terms"), sizes.alias("sizes"), F.col("runs.tf").cast("array<int>").alias("tfs"))
    dealt = lists.repartition("lead", F.pmod(F.xxhash64("doc_id"), F.lit(SPREADS))).sortWithinPartitions("lead", "dl", "doc_id")
    lined = dealt.withColumn("place", F.monotonically_increasing_id())
    block = F.shiftright("place", BLOCK_BITS) + F.lit(number << SEGMENT_BITS)
    slot = F.col("place").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows])
            numbers = rows.column("block").to_numpy()
            whole = int(np.searchsorted(numbers, numbers[-1]))  # the next batch may go on with the last block
            yield from _block_rows(rows.slice(0, whole))
            kept = rows.slice(whole)
        if kept is not None:
            yield from _block_rows(kept)

    kind = lists.schema["doc_id"].dataType.simpleString()
    schema = f"term string, block long, n long, most_tf long, least_dl int, hits array<struct<slot:int,doc_id:{kind},tf:bigint,dl:int>>, members array<struct<slot:int,doc_id:{kind},dl:int>>"
    rows = lined.select(block.alias("block"), slot.alias("slot"), "doc_id", "dl", "terms", "sizes", "tfs")
    rows.mapInArrow(blocks_of, schema).write.option("compression", "zstd").parquet(f"{path}/blocks/segment={number}")
    written = docs.sparkSession.read.parquet(f"{path}/blocks/segment={number}")
    written.select("block", F.inline("members")).select("doc_id", "block", "slot", "dl").write.option("compression", "zstd").parquet(f"{path}/docs/segment={number}")


def write_index(docs: DataFrame, path: str | None = None, doc: str = "doc_id", text: str = "text", tokenizer: Tokenizer = tokens) -> Index:
    """Builds an index of one segment below ``path`` (a new folder in the shared scratch space by default)."""
    path = path or scratch_path(docs.sparkSession, "index")
    _write_segment(docs, path, 0, doc, text, tokenizer)
    return _refresh(docs.sparkSession, path, 0, tokenizer)


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the folders ``prefix``N below a path, which is a folder of few."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def _open(spark: SparkSession, path: str, version: int, tokenizer: Tokenizer) -> Index:
    read = spark.read.parquet
    dead = read(f"{path}/dead-{version}") if version in _numbers(spark, path, "dead-") else None
    segments = [n for n in _numbers(spark, f"{path}/docs", "segment=") if n <= version]
    docs, blocks = (read(*(f"{path}/{kind}/segment={n}" for n in segments)) for kind in ("docs", "blocks"))
    return Index(path, docs, blocks.drop("members"), dead, read(f"{path}/stats-{version}"), read(f"{path}/weights-{version}"), tokenizer)


def read_index(spark: SparkSession, path: str, tokenizer: Tokenizer = tokens) -> Index:
    """The last complete version of a stored index."""
    return _open(spark, path, _numbers(spark, path, "weights-")[-1], tokenizer)


def _refresh(spark: SparkSession, path: str, version: int, tokenizer: Tokenizer) -> Index:
    """Writes the statistics of what is live; weights come last and make the version complete."""
    read = spark.read.parquet
    docs, blocks = read(f"{path}/docs"), read(f"{path}/blocks")
    dead = read(f"{path}/dead-{version}") if version in _numbers(spark, path, "dead-") else None
    corpus_stats(_live(docs, dead)).write.parquet(f"{path}/stats-{version}")
    df = blocks.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    if dead is not None:
        gone = blocks.join(small(dead), "block").select("term", "bits", F.explode("hits.slot").alias("slot")).where(has_bit(F.col("bits"), F.col("slot"))).groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
        df = df.unionByName(gone).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    term_weights(df, read(f"{path}/stats-{version}")).write.parquet(f"{path}/weights-{version}")
    return _open(spark, path, version, tokenizer)


def _next(index: Index, ids: DataFrame, batch: DataFrame | None, doc: str, text: str) -> Index:
    spark = index.docs.sparkSession
    version = _numbers(spark, index.path, "weights-")[-1] + 1
    gone = index.docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("block", bit(F.col("slot")).alias("bits"))
    if index.dead is not None:
        gone = gone.unionByName(index.dead)
    gone.groupBy("block").agg(F.bit_or("bits").alias("bits")).write.parquet(f"{index.path}/dead-{version}")
    if batch is not None:
        _write_segment(batch, index.path, version, doc, text, index.tokenizer)
    return _refresh(spark, index.path, version, index.tokenizer)


def add_documents(index: Index, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> Index:
    """The index with a batch of documents, which replace those of the same ids; one new segment is written."""
    return _next(index, docs.select(F.col(doc).alias("doc_id")), docs, doc, text)


def remove_documents(index: Index, ids: DataFrame) -> Index:
    """The index without the documents ``ids`` (doc_id); only marks are written."""
    return _next(index, ids, None, "doc_id", "text")


def top_hits(scored: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """The k best per query by rounded score, then doc_id; rank from 1."""
    order = Window.partitionBy(by).orderBy(F.round("score", SCORE_PLACES).desc(), F.col("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Pool:
    """Which documents of an index each query may find: ``masks`` (qid, block, bits) of the queries in ``restricted`` (qid); other queries may find all."""

    masks: DataFrame
    restricted: DataFrame


def pool_of_pairs(index: Index, pairs: DataFrame, queries: DataFrame) -> Pool:
    """A pool from (qid, doc_id) rows; a query without any finds nothing."""
    places = pairs.join(index.docs.select("doc_id", "block", "slot"), "doc_id")
    return Pool(places.groupBy("qid", "block").agg(F.bit_or(bit(F.col("slot"))).alias("bits")), queries.select("qid").distinct())


def _part(tf: Column, dl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + F.lit(k1) * (1 - b + F.lit(b) * dl / F.col("avgdl")))


def _bounds(terms: DataFrame, index: Index, pool: Pool | None, k1: float, b: float) -> DataFrame:
    """qid, block, bound (no document of the block scores more), and bits where there is a pool."""
    most = F.greatest(F.col("weight"), F.lit(0.0)) * _part(F.col("most_tf"), F.col("least_dl"), k1, b)
    shared = index.blocks.select("term", "block", "most_tf", "least_dl").join(small(terms), "term").crossJoin(F.broadcast(index.stats))
    bounds = shared.groupBy("qid", "block").agg(F.sum(most).alias("bound"))
    if pool is None:
        return bounds
    marked = bounds.join(small(pool.restricted.withColumn("is_restricted", F.lit(True))), "qid", "left").join(pool.masks, ["qid", "block"], "left")
    return marked.where("is_restricted is null or bits <> 0").select("qid", "block", "bound", F.when(F.col("is_restricted"), F.col("bits")).otherwise(F.lit(-1).cast("long")).alias("bits"))


def _scored(pairs: DataFrame, terms: DataFrame, index: Index, k: int, k1: float, b: float) -> DataFrame:
    """qid, doc_id, score: of each (qid, block, floor, and bits where there is a pool) of ``pairs`` the documents that share a term with the query and may be among the k best."""
    # a row a term with all that ask for it, and a row a block: neither grows with queries times blocks
    asked = small(terms.groupBy("term").agg(F.collect_list(F.struct("qid", "weight")).alias("asked")))
    hits = index.blocks.select("term", "block", F.col("hits.slot").alias("slots"), F.col("hits.tf").alias("tfs"), F.col("hits.dl").alias("lengths")).join(asked, "term")
    hits = hits.join(small(pairs.select("block").distinct()), "block", "left_semi").select("block", "slots", "tfs", "lengths", F.col("asked.qid").alias("qids"), F.col("asked.weight").alias("weights"))
    if "bits" not in pairs.columns:
        pairs = pairs.withColumn("bits", F.lit(-1).cast("long"))
    if index.dead is not None:
        pairs = pairs.join(small(index.dead.withColumnRenamed("bits", "dead_bits")), "block", "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("dead_bits", F.lit(0).cast("long")))))
    pairs = pairs.crossJoin(F.broadcast(index.stats.select(F.coalesce("avgdl", F.lit(1.0)).cast("double").alias("avgdl"))))
    pairs = pairs.select("block", "qid", "bits", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), "avgdl")
    width = 1 << BLOCK_BITS

    def score(postings: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        column = lambda table, name: table.column(name).combine_chunks()
        if postings.num_rows and queries.num_rows:
            qid, bits, floor = column(queries, "qid"), queries.column("bits").to_numpy().view(np.uint64), queries.column("floor").to_numpy()
            slots, wanted = column(postings, "slots"), column(postings, "qids")
            tf, dl = (column(postings, c).flatten().to_numpy().astype(float) for c in ("tfs", "lengths"))
            parts, holds = np.zeros((postings.num_rows, width)), np.zeros((postings.num_rows, width), np.float32)
            at = np.repeat(np.arange(postings.num_rows), slots.value_lengths().to_numpy()), slots.flatten().to_numpy()
            parts[at] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / queries.column("avgdl")[0].as_py()))
            holds[at] = 1
            term = np.repeat(np.arange(postings.num_rows), wanted.value_lengths().to_numpy())
            query_ = pc.fill_null(pc.index_in(wanted.flatten(), value_set=qid), -1).to_numpy()
            weight = column(postings, "weights").flatten().to_numpy()
            for begin in range(0, len(qid), STEP):
                n = min(STEP, len(qid) - begin)
                some = (query_ >= begin) & (query_ < begin + n)
                weights, asks = np.zeros((n, postings.num_rows)), np.zeros((n, postings.num_rows), np.float32)
                weights[query_[some] - begin, term[some]] = weight[some]
                asks[query_[some] - begin, term[some]] = 1
                open_ = (bits[begin : begin + n, None] >> np.arange(width, dtype=np.uint64)[None, :]) & np.uint64(1) > 0
                scores = np.where(open_ & (asks @ holds > 0), weights @ parts, -np.inf)
                least = floor[begin : begin + n]
                if width > k:
                    least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
                q, s = np.nonzero((scores >= least[:, None] - SLACK) & (scores > -np.inf))  # ties at the border stay for the final ranking
                found.append(pa.table({"qid": qid.take(pa.array(q + begin)), "block": pa.array(np.full(len(q), queries.column("block")[0].as_py())), "slot": pa.array(s.astype(np.int32)), "score": pa.array(scores[q, s])}))
        return pa.concat_tables(found) if found else pa.table({"qid": pa.array([], queries.schema.field("qid").type), "block": pa.array([], pa.int64()), "slot": pa.array([], pa.int32()), "score": pa.array([], pa.float64())})

    kind = pairs.schema["qid"].dataType.simpleString()
    scored = hits.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(score, f"qid {kind}, block long, slot int, score double")
    return scored.join(index.docs.select("block", "slot", "doc_id"), ["block", "slot"]).select("qid", "doc_id", "score")


@dataclass(frozen=True)
class Search:
    """Hits (qid, doc_id, score, rank) of a search and, as (qid, block), all blocks that share a term with the query and those that were scored."""

    hits: DataFrame
    blocks: DataFrame
    read: DataFrame


def pruned_search(queries: DataFrame, index: Index, k: int = 10, pool: Pool | None = None, probed: int = PROBED, k1: float = K1, b: float = B) -> Search:
    """The k best of each query, exact: blocks are left out only where their bound is below the k-th best score so far."""
    wanted = queries.select("qid", F.explode(index.tokenizer(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    terms = stored(index.weights.join(small(wanted), "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("weight")), "terms")
    bounds = stored(_bounds(terms, index, pool, k1, b), "bounds")
    order = Window.partitionBy("qid").orderBy(F.desc("bound"), "block")
    first = stored(bounds.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= probed + (k >> BLOCK_BITS)).drop("nth"), "first")
    best = stored(top_hits(_scored(first.withColumn("floor", F.lit(float("-inf"))), terms, index, k, k1, b), k), "best")
    floor = best.where(F.col("rank") == k).select("qid", F.round("score", SCORE_PLACES).alias("floor"))
    rest = bounds.join(small(first.select("qid", "block")), ["qid", "block"], "left_anti").join(small(floor), "qid", "left")
    rest = stored(rest.where("floor is null or bound >= floor - 1e-6"), "rest")  # ties at the border stay in
    both = best.drop("rank").unionByName(top_hits(_scored(rest, terms, index, k, k1, b), k).drop("rank"))
    hits = stored(top_hits(both, k).select("qid", "doc_id", "score", "rank"), "hits")  # what is made of them reads them more than once
    return Search(hits, bounds.select("qid", "block"), first.select("qid", "block").unionByName(rest.select("qid", "block")))


def bm25_search(queries: DataFrame, index: Index, k: int = 10, allowed: Pool | DataFrame | None = None) -> DataFrame:
    """qid, doc_id, score, rank for queries (qid, text); repeated query terms count again.  Scores that aren't positive are dropped after the cut.

    ``allowed`` restricts the ranking, as a Pool or as (qid, doc_id) rows; the statistics stay those of all documents.
    """
    pool = pool_of_pairs(index, allowed, queries) if isinstance(allowed, DataFrame) else allowed
    return pruned_search(queries, index, k, pool).hits.where("score > 0")


def bm25_searches(forms: dict[str, DataFrame], index: Index, k: int = 10) -> dict[str, DataFrame]:
    """The hits of ``bm25_search`` for several forms of queries, by name, from one search: what is sent for a block serves all forms."""
    batch = None
    for name, queries in forms.items():
        part = queries.select(F.concat(F.lit(f"{name}\0"), F.col("qid").cast("string")).alias("key"), F.lit(name).alias("form"), "qid", "text")
        batch = part if batch is None else batch.unionByName(part)
    batch = stored(batch, "forms")
    hits = bm25_search(batch.select(F.col("key").alias("qid"), "text"), index, k).withColumnRenamed("qid", "key")
    named = stored(hits.join(small(batch.select("key", "form", "qid").distinct()), "key").select("form", "qid", "doc_id", "score", "rank"), "hits")
    return {name: named.where(F.col("form") == name).drop("form") for name in forms}
