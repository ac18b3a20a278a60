"""Exact n-gram Jaccard join, by pivots, regions and triangle-inequality windows.

Documents are sets of word shingles under the Jaccard distance, a metric, and two
documents are linked at a distance of at most ``1 - similarity`` (here: r).

First pivots.  Almost all documents lie at distance 1 from any given document, where
no window of the triangle inequality excludes anything.  So the first pivots are one-shingle
sets.  In one order of all shingles, rarer ones first, documents at a distance of at most r
share one of the first floor(n (1 - similarity)) + 1 shingles of either; a document's region is that of its
first shingle, and the other ones are the window over which it is replicated.  The order comes from the
exact number of documents that hold each shingle.  Shingles of one document only come first and have empty
regions: a document with enough of them is linked with nothing and is done.

Frequencies are counted by request and answer.  A slice of documents sends its distinct shingles, 8 bytes
each, to the groups of the hash space; a group sends back those that a second document holds,
with their frequencies; and the slice, put together again, cuts its documents' windows.  What a slice
holds several times is sent once, with its number, so no common shingle makes a group large.

Cells.  A region's pivot document is its member with the least hash, and all regions with one pivot
form its cell, in which a document counts once.  Regions also fall apart by size: linked
documents' sizes differ by a factor of at most 1 / similarity.

Inside a cell the join is recursive: two pivots are chosen far apart, each member goes to the
nearer one's region and, within a window of 2 r, to the other's too, until a region is
small or the windows no longer shrink it; then overlaps are counted by a matrix
product.  Members known to be connected are not compared again.  A cell too large for a task
goes through the same recursion as a round of Spark jobs: blocks of its members are measured against
common pivots, members within r of a pivot are linked to it, and what is not yet connected falls into
the pivots' regions with windows of 2 r, which are cells of the next round.  Regions that the windows no
longer shrink are joined block by block, without the blocks that are connected already.  Cells return a
spanning forest of their links, so copies are never expanded into pairs, and
the forests' connected components are the classes.

Exactness rests on hashes: a shingle is its 64-bit hash, of which the sets that cells compare keep 48 bits and the
group, 53 or more in all; two different shingles of a compared pair agree by chance in one of some 10**10 pairs of documents.
Documents with equal sets (by size and 128 bits of hash) are one member.

Defined cases: a null text or one without words has an empty set and no links.  With fewer words than n the
whole sequence is the one shingle.  Rows are told apart by their own number, never by doc_id: rows with one doc_id
and different texts are one document, whose links are those of all its texts, and rows without doc_id are each a
document of their own, whose component_id is null where it reaches no doc_id.  A repeated row changes nothing.
Other columns are not read.  The input should be a table: it is read in the same order if a task is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, lookup, on_keys, stored
from .components import connected_components, forest
from .words import distinct_shingles, mix64, slice_bounds, text_slices

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
#: Characters of text for which there is one group of the hash space, and the most groups: 100 TB take the most, of some 100 million shingles each.
GROUP_CHARACTERS, MOST_GROUPS = 1 << 23, 1 << 18
#: A slice has about so many bytes of text and at most so many documents (numbered by two bytes).  With many groups it is
#: larger, so that messages hold so many shingles of some 6 bytes each, up to the most bytes.
SLICE_BYTES, SLICE_DOCUMENTS = 1 << 20, 1 << 16
MESSAGE_SHINGLES, MOST_SLICE_BYTES = 32, 1 << 24
#: Members and their shingles that one task of a cell may hold; larger cells go through rounds.
CELL_MEMBERS, CELL_SHINGLES = 512, 1_500_000
#: Pivots of a large cell, on average, and rounds after which its regions are joined block by block.
PIVOTS, ROUNDS = 16, 8
#: A cell is left to blocks when a pivot's region holds more than this share of it.
SHRINKS = 0.8
#: Regions of up to this many members are joined by one matrix product.
LEAF_MEMBERS = 12
_FIRST = np.uint64(0x5851F42D4C957F2D)
_LOW = np.uint64((1 << 48) - 1)


# ---- shingle frequencies and windows ---------------------------------------------------------------------------


def _packed(hashes: np.ndarray) -> bytes:
    """The low 48 bits of each."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


_MESSAGE = "part int, slice long, own boolean, a binary, b binary, c binary, d binary"
_NAMES = ["part", "slice", "own", "a", "b", "c", "d"]


def _message(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def _text_hash(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text, F.length(text)).alias("t2")]


def requests(docs: DataFrame, text: str, n: int, groups: int) -> DataFrame:
    """Messages of the slices: to each group, shingles of one document (a) with its number (b), and shingles of several (c)
    with how many (d).  A slice's own message has its rows (a), set sizes (b), and for its shingles of several documents how many (c) and which (d)."""

    slice_bytes = max(SLICE_BYTES, min(MOST_SLICE_BYTES, groups * MESSAGE_SHINGLES * 6))

    def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Those of a slice, hashed by parts of SLICE_BYTES."""
        found = [(x, *distinct_shingles(texts, n)) for x, _, texts in text_slices(column, SLICE_BYTES)]
        if len(found) == 1:
            return found[0][1:]
        h, owner = np.concatenate([f[1] for f in found]), np.concatenate([f[2] + f[0] for f in found])
        order = np.argsort(h, kind="stable")
        return h[order], owner[order]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            rows = batch.select([0, 1, 2])
            for a, b in slice_bounds(batch.column(3), slice_bytes, SLICE_DOCUMENTS):
                h, owner = shingles(batch.column(3).slice(a, b - a))
                sizes = np.bincount(owner, minlength=b - a)
                first = _runs(h)
                several = np.diff(np.append(first, len(h)))
                alone = first[several == 1]
                shared, many = h[first[several > 1]], several[several > 1]
                part = (h[alone] >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
                part2 = (shared >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
                edges, edges2 = (np.searchsorted(p, np.arange(groups + 1, dtype=np.uint64)) for p in (part, part2))
                h1, who, how_many = _packed(h[alone]), owner[alone].astype("<u2"), many.astype("<u4")
                h2 = _packed(shared)
                out = []
                for p in range(groups):
                    i, j, k, m = edges[p], edges[p + 1], edges2[p], edges2[p + 1]
                    if i < j or k < m:
                        out.append((p, number, False, h1[6 * i : 6 * j], who[i:j].tobytes(), h2[6 * k : 6 * m], how_many[k:m].tobytes()))
                those = np.ones(len(h), dtype=bool)
                those[alone] = False
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as writer:
                    writer.write_batch(rows.slice(a, b - a))
                home = int(mix64(np.array([number], np.uint64))[0] % np.uint64(groups))
                out.append((home, number, True, sink.getvalue().to_pybytes(), sizes.astype("<u4").tobytes(), how_many.tobytes(), owner[those].astype("<u2").tobytes()))
                yield _message(out)
                number += 1

    return docs.select("doc_id", *_text_hash(text), text).mapInArrow(send, _MESSAGE)


def answers(asked: DataFrame) -> DataFrame:
    """Messages to the slices: their shingles that a second document holds (a), with its number (b) and the class of their
    frequency (c); the shingles of several documents (a without b) come as a message of their own."""

    def answer(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices, who, hashes, weights, kinds = [], [], [], [], []
        for batch in batches:
            for part, number, own, a, b, c, d in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if own:
                    yield _message([(part, number, own, a, b, c, d)])
                    continue
                for raw, extra in ((a, b), (c, None)):
                    if raw:
                        found = _unpacked(raw)
                        slices.append(number)
                        who.append(extra)
                        hashes.append(found)
                        weights.append(np.ones(len(found), np.int64) if extra is not None else np.frombuffer(d, "<u4").astype(np.int64))
        if not hashes:
            return
        every, weight = np.concatenate(hashes), np.concatenate(weights)
        order = np.argsort(every)
        first = _runs(every[order])
        total = np.add.reduceat(weight[order], first)
        frequency = np.empty(len(every), dtype=np.int64)
        frequency[order] = np.repeat(total, np.diff(np.append(first, len(every))))
        level = np.minimum(255, np.round(8 * np.log2(frequency))).astype(np.uint8)
        part, at, out = key[0].as_py(), 0, []
        for number, numbers, found in zip(slices, who, hashes, strict=True):
            here = slice(at, at + len(found))
            at += len(found)
            keep = frequency[here] > 1
            if keep.any():
                out.append((part, number, False, _packed(found[keep]), None if numbers is None else np.frombuffer(numbers, "<u2")[keep].tobytes(), level[here][keep].tobytes(), None))
            if len(out) >= 1000:
                yield _message(out)
                out = []
        if out:
            yield _message(out)

    return asked.groupBy("part").applyInArrow(answer, _MESSAGE)


_SETS = "row long, doc_id long, t1 long, t2 long, n_shingles int, s1 long, s2 long, early int, window array<long>, held int, shared binary"


def shingle_sets(docs: DataFrame, text: str, n: int, percent: int) -> DataFrame:
    """One row per row of ``docs``: row (a number), doc_id, t1 and t2 (the text's hash), n_shingles; and where links are possible
    the set's name (s1, s2), its window of shingles, how many of these are early, and the ``held`` shingles that other documents hold too."""
    characters = docs.agg(F.sum(F.length(text))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = min(MOST_GROUPS, max(4 * partitions, characters // GROUP_CHARACTERS))  # more than tasks, so that these are of like size

    def cut(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own, found = key[0].as_py(), None, []
        for batch in batches:
            for part, _, is_own, a, b, c, d in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if is_own:
                    own = (a, b, c, d)
                else:
                    found.append((part, b is None, _unpacked(a) | np.uint64((part & 0x7FFF) << 48), b, c))
        rows = pa.ipc.open_stream(own[0]).read_all()
        sizes = np.frombuffer(own[1], "<u4").astype(np.int64)
        found.sort(key=lambda x: x[:2])
        none = np.zeros(0, np.uint64)
        alone = [x for x in found if not x[1]]
        several = [x for x in found if x[1]]
        how_many = np.frombuffer(own[2], "<u4").astype(np.int64)
        keys = np.concatenate([none, *(x[2] for x in alone), np.repeat(np.concatenate([none, *(x[2] for x in several)]), how_many)])
        owner = np.concatenate([np.frombuffer(x[3], "<u2") for x in alone] + [np.frombuffer(own[3], "<u2")]).astype(np.int64)
        level = np.frombuffer(b"".join(x[4] for x in alone), np.uint8), np.repeat(np.frombuffer(b"".join(x[4] for x in several), np.uint8), how_many)
        order = np.lexsort((keys, np.concatenate(level), owner))
        keys = keys[order]
        shared = np.bincount(owner, minlength=len(sizes))
        stops = np.cumsum(shared)
        unique = sizes - shared
        reach = np.where(sizes > 0, sizes * (100 - percent) // 100 + 1, 0)
        within = np.maximum(reach - unique, 0)
        early = np.clip(sizes * (100 - percent) // (100 + percent) + 1 - unique, 0, within)
        s1, s2, windows, sets = [], [], [], []
        for d in range(len(sizes)):
            if not within[d]:
                s1.append(None), s2.append(None), windows.append(None), sets.append(None)
                continue
            mine = keys[stops[d] - shared[d] : stops[d]]
            windows.append(mine[: within[d]].view(np.int64))
            mine = np.sort(mine)
            sets.append(mine.tobytes())
            # sets with shingles of their own are like no other, and are named by their row
            name = (mix64(mine).sum(dtype=np.uint64), mix64(mine ^ _FIRST).sum(dtype=np.uint64)) if not unique[d] else (np.uint64(number), np.uint64(d))
            s1.append(int(name[0].view(np.int64))), s2.append(int(name[1].view(np.int64)))
        row = (np.int64(number) << 16) + np.arange(len(sizes))
        columns = [row, *rows.columns, sizes, s1, s2, early, windows, shared, sets]
        kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
        arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _SETS.split(", ")])

    asked = requests(docs, text, n, groups)
    return stored(answers(asked).groupBy("slice").applyInArrow(cut, _SETS), "sets")


# ---- regions and cells -----------------------------------------------------------------------------------------


def cells(members: DataFrame, percent: int) -> DataFrame:
    """(cell, member): for each pivot document the members of its regions; members: member, n_shingles, early, window."""
    # sizes fall into bands of a factor of two; those near enough to the next band's least also go there
    band = F.floor(F.log2("n_shingles")).cast("int")
    next_ = F.floor(F.log2(F.col("n_shingles") * 100 / F.lit(percent) + 1)).cast("int")
    rows = members.select("member", "early", F.sequence(band, next_).alias("bands"), F.posexplode("window").alias("at", "shingle"))
    rows = rows.select("member", (F.col("at") < F.col("early")).alias("is_early"), "shingle", F.explode("bands").alias("band"))
    rows = rows.select("member", "is_early", F.xxhash64("shingle", "band").alias("region"))
    by_hash = F.struct(F.xxhash64("member").alias("hash"), "member")
    heads = rows.groupBy("region").agg(F.min(by_hash).alias("head"), F.count(F.lit(1)).alias("rows"), F.max("is_early").alias("has_early"))
    # of two linked sets the smaller one holds a shared shingle early
    heads = heads.where("rows > 1 and has_early").select("region", F.col("head.member").alias("cell"), "rows")
    found = lookup(rows.select("region", "member"), heads, ["region"], ["cell"], "rows", F.col("member")).where("cell is not null")
    return stored(found.select("cell", "member").distinct(), "cells")


# ---- the join inside a cell ------------------------------------------------------------------------------------


class _Forest:
    """Union-find over the members of one task's cell."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def roots(self) -> np.ndarray:
        p = self.parent
        while (p != p[p]).any():
            p = p[p]
        self.parent = p
        return p

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            i, j = self.root(i), self.root(j)
            if i != j:
                self.parent[max(i, j)] = min(i, j)


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets ``left`` (rows) and ``right`` (columns), by matrix products over the shingles they share."""
    a, b = np.concatenate([sets[i] for i in left]), np.concatenate([sets[i] for i in right])
    sizes = np.array([len(sets[i]) for i in right])
    if len(left) == 1:  # the pivot's set is sorted
        at = np.minimum(np.searchsorted(a, b), max(len(a) - 1, 0))
        inside = a[at] == b if len(a) else np.zeros(len(b), dtype=bool)
        return np.bincount(np.repeat(np.arange(len(right)), sizes), inside, len(right))[None, :].astype(np.float32)
    vocabulary = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    row_a = np.repeat(np.arange(len(left)), [len(sets[i]) for i in left])
    row_b = np.repeat(np.arange(len(right)), sizes)
    if not len(vocabulary):
        return out
    at_a, at_b = np.searchsorted(vocabulary, a), np.searchsorted(vocabulary, b)
    in_a, in_b = vocabulary[np.minimum(at_a, len(vocabulary) - 1)] == a, vocabulary[np.minimum(at_b, len(vocabulary) - 1)] == b
    row_a, at_a, row_b, at_b = row_a[in_a], at_a[in_a], row_b[in_b], at_b[in_b]
    step = 4096
    for begin in range(0, len(vocabulary), step):
        width = min(step, len(vocabulary) - begin)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        pick = (at_a >= begin) & (at_a < begin + width)
        x[row_a[pick], at_a[pick] - begin] = 1
        pick = (at_b >= begin) & (at_b < begin + width)
        y[row_b[pick], at_b[pick] - begin] = 1
        out += x @ y.T
    return out


def join_cell(sets: list[np.ndarray], sizes: np.ndarray, percent: int, leaf: int = LEAF_MEMBERS, known: np.ndarray | None = None) -> np.ndarray:
    """For each set the least index of its class, where sets with a Jaccard similarity of percent / 100 or more are linked.

    ``sets`` may leave out shingles that no other set has; ``sizes`` counts them.  Sets with one ``known`` class are connected already.
    """
    n = len(sets)
    forest = _Forest(n)
    radius = (100 - percent) / 100
    if known is not None:
        _, first, at = np.unique(known, return_index=True, return_inverse=True)
        forest.join(first[at], np.arange(n))

    def linked(left: np.ndarray, right: np.ndarray, overlap: np.ndarray) -> np.ndarray:
        inter = overlap.astype(np.int64)
        return 100 * inter >= percent * (sizes[left][:, None] + sizes[right][None, :] - inter)

    def distances(pivot: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inter = _overlaps(sets, np.array([pivot]), members)
        return 1 - inter[0] / np.maximum(sizes[pivot] + sizes[members] - inter[0], 1), linked(np.array([pivot]), members, inter)[0]

    def compare(left: np.ndarray, right: np.ndarray) -> None:
        found = linked(left, right, _overlaps(sets, left, right))
        i, j = np.nonzero(found)
        roots = forest.roots()
        open_ = roots[left[i]] != roots[right[j]]
        forest.join(left[i][open_], right[j][open_])

    def dense(members: np.ndarray) -> None:
        width = max(leaf, 256)
        blocks = [members[i : i + width] for i in range(0, len(members), width)]
        for i, left in enumerate(blocks):
            for right in blocks[i:]:
                roots = forest.roots()
                if len(np.unique(roots[np.concatenate((left, right))])) > 1:
                    compare(left, right)

    def recurse(members: np.ndarray, depth: int) -> None:
        roots = forest.roots()
        if len(np.unique(roots[members])) < 2:
            return
        if len(members) <= leaf or depth > 20:
            return dense(members)
        near = members[0]
        first, hit = distances(near, members)
        forest.join(np.full(hit.sum(), near), members[hit])
        far = members[int(first.argmax())]
        second, hit = distances(far, members)
        forest.join(np.full(hit.sum(), far), members[hit])
        window = 2 * radius + 1e-6
        parts = [members[first <= second + window], members[second <= first + window]]
        if max(map(len, parts)) > 0.8 * len(members):
            return dense(members)
        for part in parts:
            recurse(part, depth + 1)

    recurse(np.argsort(sizes, kind="stable"), 0)
    return forest.roots()


def _members_of(rows: Iterator[pa.RecordBatch]) -> tuple[pa.Table | None, list[np.ndarray], np.ndarray]:
    """The rows of a group, their sets and sizes."""
    batches = list(rows)
    if not batches:
        return None, [], np.zeros(0, np.int64)
    table = pa.Table.from_batches(batches)
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shared").to_pylist()]
    return table, sets, table.column("n_shingles").to_numpy().astype(np.int64)


def _joined(percent: int):
    """The function of a group of members that gives the links (a, b) of a spanning forest."""

    def cell(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sets, sizes = _members_of(batches)
        members = table.column("member").to_numpy()
        known = table.column("class").to_numpy() if "class" in table.column_names else None
        roots = join_cell(sets, sizes, percent, known=known)
        linked = roots != np.arange(len(members))
        if known is not None:  # one link for each class that was connected before
            first = np.zeros(len(members), dtype=bool)
            first[np.unique(known, return_index=True)[1]] = True
            linked &= first
        yield pa.RecordBatch.from_arrays([pa.array(members[linked], pa.int64()), pa.array(members[roots[linked]], pa.int64())], names=["a", "b"])

    return cell


_LINKS = "a long, b long"


def small_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within cells that a task can hold."""
    return rows.select("cell", "member").join(sets, "member").select("cell", "member", "n_shingles", "shared").groupBy("cell").applyInArrow(_joined(percent), _LINKS)


def round_of_pivots(rows: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int, last: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One step of the recursion over large cells (cell, member, class; sizes: cell, members, blocks): links to pivots; the cells
    that windows don't shrink, with their sizes; and the regions that are left of the others as new cells."""
    radius = (100 - percent) / 100
    sized = stored(rows.join(sizes.select("cell", "members", "blocks"), "cell"), "large")  # cells that are joined are few: each has over CELL_MEMBERS rows
    pivots = sized.where(F.pmod(F.xxhash64("member", F.lit(5)), F.col("members")) < PIVOTS).select("cell", F.col("member").alias("pivot"), "blocks")
    least = sized.groupBy("cell", "blocks").agg(F.min_by("member", F.xxhash64("member", F.lit(6))).alias("pivot")).select("cell", "pivot", "blocks")
    pivots = stored(pivots.union(least).distinct(), "pivots")
    sent = pivots.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("pivot").alias("member"), F.lit(True).alias("is_pivot"), F.lit(0).cast("long").alias("class"))
    block = F.pmod(F.xxhash64("member", F.lit(3)), F.col("blocks")).cast("int")
    every = sized.select("cell", block.alias("block"), "member", F.lit(False).alias("is_pivot"), "class").unionByName(sent)
    every = every.join(sets, "member").select("cell", "block", "member", "is_pivot", "class", "n_shingles", "shared")

    def measure(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sets_, sizes_ = _members_of(batches)
        flags = np.array(table.column("is_pivot").to_pylist(), dtype=bool)
        ids, classes = table.column("member").to_numpy(), table.column("class").to_numpy()
        of = np.flatnonzero(flags)
        of = of[np.argsort(ids[of])]
        rest = np.flatnonzero(~flags)
        inter = _overlaps(sets_, of, rest).astype(np.int64)
        both = sizes_[of][:, None] + sizes_[rest][None, :] - inter
        own = ids[of][:, None] == ids[rest][None, :]
        hit = (100 * inter >= percent * both) | own
        distance = np.where(own, 0, 1 - inter / np.maximum(both, 1))
        window = distance <= distance.min(axis=0)[None, :] + 2 * radius + 1e-6
        lists = lambda flags_: pa.array([ids[of][flags_[:, i]] for i in range(len(rest))], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(rest), pa.int64()), pa.array(ids[rest]), pa.array(classes[rest]), lists(hit), lists(window)], names=["cell", "member", "class", "hits", "near"])

    measured = stored(every.groupBy("cell", "block").applyInArrow(measure, "cell long, member long, class long, hits array<long>, near array<long>"), "measured")
    links = measured.select(F.col("member").alias("a"), F.explode("hits").alias("b")).where("a <> b")
    # what connects pivots: the members of one class that are linked with several
    hit = measured.select("cell", "class", F.explode("hits").alias("hit")).groupBy("cell", "class").agg(F.collect_set("hit").alias("hits"))
    hit = stored(hit, "hit")
    ties = hit.select("cell", F.array_min("hits").alias("a"), F.explode("hits").alias("b")).distinct()  # at most a cell's pivots squared

    def tie(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        nodes, tops = forest(table.column("a").to_numpy(), table.column("b").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(nodes), pa.int64()), pa.array(nodes), pa.array(tops)], names=["cell", "pivot", "top"])

    tops = ties.groupBy("cell").applyInArrow(tie, "cell long, pivot long, top long")
    classes = hit.select("cell", "class", F.array_min("hits").alias("pivot")).join(tops, ["cell", "pivot"]).select("cell", "class", "top")
    merged = measured.join(stored(classes, "classes"), ["cell", "class"], "left").select("cell", "member", F.coalesce("top", "class").alias("class"), "near")
    merged = stored(merged, "merged")
    reached = merged.select("cell", F.explode("near").alias("pivot")).groupBy("cell", "pivot").agg(F.count(F.lit(1)).alias("n"))
    state = merged.groupBy("cell").agg(F.min("class").alias("one"), F.max("class").alias("other")).where("one <> other").select("cell")
    state = state.join(reached.groupBy("cell").agg(F.max("n").alias("largest_region")), "cell").join(sizes.select("cell", "members", "blocks"), "cell")
    state = stored(state.withColumn("stuck", (F.col("largest_region") > SHRINKS * F.col("members")) | F.lit(last)), "state")
    stuck = merged.join(state.where("stuck").select("cell"), "cell", "left_semi").select("cell", "member", "class")
    regions = merged.join(state.where("not stuck").select("cell"), "cell", "left_semi").select("cell", "member", "class", F.explode("near").alias("pivot"))
    regions = regions.select(F.xxhash64("cell", "pivot").alias("cell"), "member", "class")
    several = regions.groupBy("cell").agg(F.min("class").alias("one"), F.max("class").alias("other")).where("one <> other")
    return stored(links, "pivot_links"), stuck, state.where("stuck").select("cell", "members", "blocks"), stored(regions.join(several.select("cell"), "cell", "left_semi"), "regions")


def block_links(rows: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within cells that recursion doesn't shrink: blocks of members outside the largest class meet all blocks."""
    counted = rows.groupBy("cell", "class").agg(F.count(F.lit(1)).alias("n"))
    largest = counted.groupBy("cell").agg(F.max_by("class", F.struct("n", "class")).alias("largest"), F.max("n").alias("n_largest"))
    dealt = rows.join(largest, "cell").join(sizes.select("cell", "members", "blocks"), "cell")
    main = F.col("class") == F.col("largest")
    parts = lambda n: F.ceil(F.col("blocks") * n / F.col("members")).cast("int")
    others = F.greatest(parts(F.col("members") - F.col("n_largest")), F.lit(1))
    inner = F.greatest(parts(F.col("n_largest")), F.lit(1))
    hashed = F.xxhash64("member", F.lit(4))
    dealt = dealt.select("cell", "member", "class", main.alias("main"), others.alias("others"), inner.alias("inner"), hashed.alias("hash"))
    block = F.when(F.col("main"), F.col("others") + F.pmod("hash", F.col("inner"))).otherwise(F.pmod("hash", F.col("others"))).cast("int")
    dealt = dealt.withColumn("block", block)
    meets = F.expr("transform(sequence(0, if(main, others, others + inner) - 1), j -> struct(least(block, j) as i, greatest(block, j) as j))")
    dealt = dealt.select("cell", "member", "class", F.explode(meets).alias("meet")).select("cell", "member", "class", "meet.i", "meet.j")
    return dealt.join(sets, "member").select("cell", "i", "j", "member", "class", "n_shingles", "shared").groupBy("cell", "i", "j").applyInArrow(_joined(percent), _LINKS)


def cell_links(cell_rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of a spanning forest of the links within all cells; sets: member, n_shingles, held, shared."""
    links, depth = None, 0
    rows = cell_rows.withColumn("class", F.col("member"))
    while True:
        sizes = rows.join(sets.select("member", "held"), "member").groupBy("cell").agg(F.count(F.lit(1)).alias("members"), F.sum("held").alias("shingles"))
        blocks = F.ceil(F.greatest(F.col("shingles") / F.lit(CELL_SHINGLES), F.col("members") / F.lit(CELL_MEMBERS))).cast("int")
        sizes = stored(sizes.select("cell", "members", blocks.alias("blocks")), "sizes")
        found = small_links(rows.join(sizes.where("blocks = 1 and members > 1"), "cell", "left_semi"), sets, percent)
        large = sizes.where("blocks > 1")
        rest = None
        if not large.isEmpty():
            of_pivots, stuck, stuck_sizes, rest = round_of_pivots(rows.join(large, "cell", "left_semi"), large, sets, percent, depth >= ROUNDS)
            found = found.unionByName(of_pivots)
            if not stuck_sizes.isEmpty():
                found = found.unionByName(block_links(stuck, stuck_sizes, sets, percent))
        found = stored(found, "links")
        links = found if links is None else links.unionByName(found)
        if rest is None or rest.isEmpty():
            return links
        rows, depth = rest, depth + 1


# ---- the operator ----------------------------------------------------------------------------------------------


def _linked(docs: DataFrame, text: str, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (row, doc_id, t1, t2, n_shingles, open), row and member of the open ones, and links between members."""
    table = shingle_sets(docs, text, n, percent)
    with_window = F.col("shared").isNotNull()
    rows = table.select("row", "doc_id", "t1", "t2", "n_shingles", with_window.alias("open"))
    open_ = table.where(with_window)
    key = ["n_shingles", "s1", "s2"]
    names = open_.groupBy(*key).agg(F.min("row").alias("member"), F.count(F.lit(1)).alias("rows"))
    member_of = stored(lookup(open_.select("row", *key), names, key, ["member"], "rows", F.col("row")).select("row", "member"), "members")
    chosen = member_of.where("row = member").select("member")
    members = stored(open_.join(chosen, open_["row"] == chosen["member"]).select("member", "n_shingles", "early", "window", "held", "shared"), "members")
    cell_rows = cells(members, percent)
    return rows, member_of, cell_links(cell_rows, members.select("member", "n_shingles", "held", "shared"), percent)


def _ranked(open_rows: DataFrame, edges: DataFrame, rank: Column) -> DataFrame:
    """``open_rows`` (with row and member) and best: the least ``rank`` in the row's component."""
    of_member = stored(open_rows.groupBy("member").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("rows")), "of_member")
    found = connected_components(edges).select(F.col("node").alias("member"), "component")
    of_member = stored(of_member.join(found, "member", "left").withColumn("component", F.coalesce("component", "member")), "of_member")
    least = stored(of_member.groupBy("component").agg(F.min("best").alias("best")), "least")
    best = of_member.select("component", "member", "rows").join(least, "component").select("member", "best", "rows")
    return lookup(open_rows, best, ["member"], ["best"], "rows", F.col("row"))


def jaccard_classes(docs: DataFrame, text: str = "text", n: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    rows, member_of, links = _linked(docs, text, n, percent)
    known = rows.where("doc_id is not null")
    repeated = stored(known.groupBy("doc_id").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "repeated")
    if not repeated.isEmpty():  # rows of one doc_id are one document
        tied = lookup(known.select("row", "doc_id"), repeated, ["doc_id"], ["least"], "rows", F.col("row")).where("least is not null")
        alone = rows.where("not open").select("row", F.col("row").alias("member"))
        member_of = stored(member_of.unionByName(alone.join(tied.select("row"), "row", "left_semi")), "members")
        ties = tied.join(member_of, "row").select("least", "member")
        ties = ties.join(member_of.select(F.col("row").alias("least"), F.col("member").alias("first")), "least").select(F.col("member").alias("a"), F.col("first").alias("b"))
        links = links.unionByName(ties.distinct())
    joined = stored(rows.join(member_of, "row", "left").select("row", "doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "member"), "joined")
    ranked = _ranked(joined.where("member is not null"), links, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    alone = joined.where("member is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return alone.unionByName(ranked.select("doc_id", "n_shingles", F.col("best.doc_id").alias("component_id")))


def keep_one_of_near(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each class of near copies, that of the smallest doc_id, with all its columns; texts without words all stay.

    Classes are those of links alone, so of two texts with one doc_id each goes by its own.  Rows without doc_id rank last.
    Repeated rows (doc_id and text) are copies too, of which any one stays.
    """
    rows, member_of, links = _linked(docs, text, SHINGLE_WORDS, SIMILARITY_PERCENT)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    ranked = stored(_ranked(rows.join(member_of, "row"), links, rank).withColumn("rank", rank), "ranked")
    lost = stored(ranked.where("rank <> best").select("doc_id", "t1", "t2").distinct(), "lost")
    counted = ranked.where("rank = best").groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("n"))
    again = stored(counted.where("n > 1").select("doc_id", "t1", "t2"), "again")
    left = carried(docs, [F.col("doc_id"), *_text_hash(text)])
    left = left.join(lost, on_keys(lost), "left_anti")
    if not again.isEmpty():
        once = left.join(again, on_keys(again), "left_semi").groupBy("k0", "k1", "k2").agg(F.any_value("whole").alias("whole"))
        left = left.join(again, on_keys(again), "left_anti").select("whole").unionByName(once.select("whole"))
    return left.select("whole.*")
