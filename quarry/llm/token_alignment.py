"""Alignment of two tokenizers, with corpus-wide counts of linked pairs of ids.

Both tokenizers cut the bytes of the same text, so the ends of their tokens are places in one
row of bytes.  Places where tokens of both end part the text into groups; between any two
neighbouring ends exactly one token of each lies, which makes one link.

A pair of ids is one int64, the first id above the second.  Tasks count in how many
documents each pair occurs with np.unique over slices of documents.  These partial
counts are sorted globally by ranges of the key, and runs of equal keys are summed and written
as sorted shards of raw int64 keys and counts.  For the result, tasks map the shards into memory
and look pairs up by np.searchsorted, a slice's distinct pairs at a time in key order.  A
pair that every document has is one row a slice buffer before the sort and one row in its shard.

Tokens are encoded once and stored as ids; links are cheap and made twice.  The shards
lie in the shared folder; where that is no file system that can be mapped, a task reads one shard at a
time.  The driver gets one row a shard and one number for each id of the first vocabulary.

Defined cases: a null or empty text, one that is no UTF-8, and one that either tokenizer does not keep
byte by byte have no tokens, so only zeros and no groups.  A repeated row is one more document.
A null doc_id is an id like any other.  Long texts are encoded and linked piece by piece (at
spaces that no token of either tokenizer can span); only their ids and their group text are held whole.
Other columns are not read.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import stored
from .words import slice_bounds, text_slices

#: Fixed value: how byte-level BPE parts a text before its merges.
BYTE_LEVEL_PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space of Unicode, as the pattern sees it: all but space and line feed, and with them.
OTHER_WHITE = "\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = " \n" + OTHER_WHITE
PIECE, CACHED_WORDS = 1 << 20, 400_000
SLICE_BYTES = 1 << 20  # of stored ids
STRETCH_TOKENS = 1 << 20
PARTIAL_PAIRS = 1 << 22


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """A byte-level BPE file.  Ids that follow the order of merges are ranks, which a faster encoder takes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte = _byte_of_character()
        special = {t["content"] for t in file["added_tokens"]}
        entries = {bytes(byte[c] for c in entry): i for entry, i in file["model"]["vocab"].items() if entry not in special}
        self.bytes_of = [b""] * (max(max(entries.values()), *(t["id"] for t in file["added_tokens"]), 0) + 1)
        for entry, i in entries.items():
            self.bytes_of[i] = entry
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in file["model"]["merges"]]
        if [file["model"]["vocab"][a + b] for a, b in merges] == list(range(256, 256 + len(merges))) and len(entries) == 256 + len(merges):
            import tiktoken

            self.encode = tiktoken.Encoding("byte_level", pat_str=BYTE_LEVEL_PARTS, mergeable_ranks=entries, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            self.encode = lambda text: model.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """A sentence-piece model that adds a space in front."""

    SPACE = "\u2581"

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i).replace(self.SPACE, " ") for i in range(model.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.encode() for i, p in enumerate(pieces)]
        self.parts_before_space = not any(re.search(f"[^{WHITE}][ \n]", p) for p in pieces)
        self.encode = lambda text: model.encode(text[1:])


class Pair:
    """Both tokenizers, the lengths of their tokens and the type that holds their ids.

    Byte-level parts end where white space begins after anything else; if no piece of the other
    model goes on with a space or a line feed there, words with such white space before them are encoded alone, whatever stands around
    them.  A bounded cache keeps the ids of words; new ones are encoded together and parted at their ends.
    """

    WORD = re.compile(f"[{WHITE}]*[^{WHITE}]+(?:[{OTHER_WHITE}][{WHITE}]*[^{WHITE}]+)*(?:[{WHITE}]+\\Z)?|[{WHITE}]+")
    ENDS_WHITE = re.compile(f"[{WHITE}]\\Z")
    CUT = re.compile(r"(?<=\S) (?=[A-Za-z])")  # a space where a word begins
    BEFORE = " x"  # stands before new words, so that the space in front is not theirs

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.a_size, self.b_size = (np.array([len(x) for x in t.bytes_of], dtype=np.int64) for t in (self.a, self.b))
        self.dtype = np.dtype("<u2" if max(len(self.a_size), len(self.b_size)) <= 1 << 16 else "<u4")
        self.known: dict[str, tuple[bytes, bytes] | tuple] = {}  # of words whose bytes a tokenizer does not keep, the empty tuple

    def _both(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text that begins with a space; None where its bytes are not kept."""
        want, ids = text.encode(), (self.a.encode(text), self.b.encode(text))
        if any(b"".join(map(t.bytes_of.__getitem__, i)) != want for t, i in zip((self.a, self.b), ids, strict=True)):
            return None
        return tuple(np.array(i, dtype=self.dtype) for i in ids)

    def _learn(self, words: list[str]) -> None:
        """Keeps the ids of words, of which only the last may end with white space."""
        found = self._both(self.BEFORE + "".join(words))
        if found is None:
            if len(words) == 1:
                self.known[words[0]] = ()
            else:
                half = len(words) // 2
                self._learn(words[:half])
                self._learn(words[half:])
            return
        ends = len(self.BEFORE) + np.cumsum([0] + [len(w.encode()) for w in words])
        parts = []
        for ids, size in zip(found, (self.a_size, self.b_size), strict=True):
            stops = ((np.searchsorted(np.cumsum(size[ids]), ends) + 1) * self.dtype.itemsize).tolist()
            letters = ids.tobytes()
            parts.append([letters[x:y] for x, y in zip(stops, stops[1:], strict=False)])
        self.known.update(zip(words, zip(*parts, strict=True), strict=True))

    def _pieces(self, text: str) -> Iterator[str]:
        """The text with a space in front, in pieces that begin with one each."""
        text, begin = " " + text, 0
        while begin < len(text):
            gap = self.CUT.search(text, begin + PIECE) if len(text) - begin > PIECE else None
            yield text[begin : gap.start() if gap else len(text)]
            begin = gap.start() if gap else len(text)

    def encode(self, bodies: list[bytes | None]) -> list[tuple[bytes, bytes]]:
        """Ids of both for each text; none where the text is not kept."""
        out: list[tuple[bytes, bytes]] = []
        for body in bodies:
            try:
                text = (body or b"").decode("utf-8")
            except UnicodeDecodeError:
                text = ""
            if not text:
                out.append((b"", b""))
            elif self.b.parts_before_space:
                pieces = [self._ids(p) for p in self._pieces(text)]
                out.append((b"", b"") if None in pieces else tuple(map(b"".join, zip(*pieces, strict=True))))
            else:
                found = self._both(" " + text)
                out.append(tuple(i.tobytes() for i in found) if found else (b"", b""))
        return out

    def _ids(self, piece: str) -> tuple[bytes, bytes] | None:
        words = self.WORD.findall(piece)
        found = list(map(self.known.get, words))
        new = {w for w, f in zip(words, found, strict=True) if f is None}
        if new:
            if len(self.known) + len(new) > CACHED_WORDS:
                self.known = {}
                new = set(words)
            if words[-1] in new and self.ENDS_WHITE.search(words[-1]):
                new.discard(words[-1])
                self._learn(words[-1:])
            self.known.update((w, ()) for w in new if self.b.SPACE in w)
            if new := [w for w in new if self.b.SPACE not in w]:
                self._learn(new)
            found = list(map(self.known.get, words))
        if () in found:
            return None
        return b"".join([f[0] for f in found]), b"".join([f[1] for f in found])


@lru_cache(maxsize=4)
def pair_of(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def token_ids(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """doc_id and the ids of both tokenizers (little-endian, in the narrowest type for both vocabularies)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_path, b_path)
        for batch in batches:
            for x, y, bodies in text_slices(batch.column(1)):
                ids = pair.encode(bodies)
                arrays = [pa.array([i[k] for i in ids], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), *arrays], names=["doc_id", "a_ids", "b_ids"])

    return docs.select("doc_id", F.col(text).cast("binary").alias("body")).mapInArrow(encode, "doc_id long, a_ids binary, b_ids binary")


class Stretch(NamedTuple):
    """Whole groups of some documents: their tokens, and a mark at the last byte of each (1 a token of the first tokenizer ends there, 2 one of the second, 3 both)."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    marks: np.ndarray
    a_from: int


def stretches(a_ids: np.ndarray, b_ids: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, most: int = STRETCH_TOKENS) -> Iterator[Stretch]:
    """The tokens of documents laid end to end, in stretches of up to about ``most`` tokens of each that end with a group."""
    i = j = 0
    wide = most
    while i < len(a_ids):
        a, b = a_ids[i : i + wide].astype(np.int64), b_ids[j : j + wide].astype(np.int64)
        a_ends, b_ends = np.cumsum(a_size[a]), np.cumsum(b_size[b])
        marks = np.zeros(max(a_ends[-1], b_ends[-1]), dtype=np.uint8)
        marks[a_ends - 1] = 1
        marks[b_ends - 1] += 2
        if i + wide < len(a_ids) or j + wide < len(b_ids):
            both = np.flatnonzero(marks == 3)
            if not len(both):
                wide *= 2
                continue
            marks = marks[: both[-1] + 1]
            a, b = a[: np.count_nonzero(marks & 1)], b[: np.count_nonzero(marks & 2)]
        yield Stretch(a, b, marks[marks != 0], i)
        i, j, wide = i + len(a), j + len(b), most


class Links(NamedTuple):
    """Links of a stretch, in order: the pair's key and the document's number among those of the slice."""

    keys: np.ndarray
    docs: np.ndarray


def links_of(s: Stretch, a_bounds: np.ndarray) -> Links:
    """``a_bounds[d]`` is how many tokens the documents up to the d-th have."""
    a_ends, b_ends = s.marks & 1, s.marks >> 1
    a, b = np.cumsum(a_ends, dtype=np.int64) - a_ends, np.cumsum(b_ends, dtype=np.int64) - b_ends  # the tokens that end here, or go on
    first, last = np.searchsorted(a_bounds, s.a_from, side="right"), np.searchsorted(a_bounds, s.a_from + len(s.a_ids))
    begins = np.searchsorted(a, a_bounds[first:last] - s.a_from)  # links of later documents
    docs = np.zeros(len(a), dtype=np.int64)
    np.add.at(docs, begins, 1)
    return Links(s.a_ids[a] << 32 | s.b_ids[b], np.cumsum(docs) + first)


def _slices(batch: pa.RecordBatch, dtype: np.dtype) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row ranges with all their ids of both tokenizers and how many the rows up to each one have."""
    for x, y in slice_bounds(batch.column(1), SLICE_BYTES):
        columns = []
        for k in (1, 2):
            rows = [v.as_buffer() for v in batch.column(k).slice(x, y - x)]
            columns += [np.frombuffer(b"".join(rows), dtype), np.cumsum([r.size // dtype.itemsize for r in rows])]
        yield x, y, *columns


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def partial_counts(tokens: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """pair and count: in how many documents of a part of the corpus the pair is linked."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_path, b_path)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = held[0]
            for i in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 18)]), pa.array(counts[i : i + (1 << 18)])], names=["pair", "count"])

        for batch in batches:
            for _, _, a_ids, a_bounds, b_ids, _ in _slices(batch, pair.dtype):
                seen, in_docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for s in stretches(a_ids, b_ids, pair.a_size, pair.b_size):
                    links = links_of(s, a_bounds)
                    keys, at = np.unique(np.concatenate((seen, links.keys)), return_inverse=True)
                    rows = np.unique(np.concatenate((in_docs, links.docs)) * len(keys) + at)  # each pair once a document
                    seen, in_docs = keys[rows % len(keys)], rows // len(keys)
                if len(seen):
                    held.append(np.unique(seen, return_counts=True))
                    size += len(held[-1][0])
                if size > PARTIAL_PAIRS:
                    held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size > PARTIAL_PAIRS // 2:
                        yield from out()
                        held, size = [], 0
        if held:
            held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
            yield from out()

    return tokens.mapInArrow(count, "pair long, count long")


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class Shard(NamedTuple):
    """A sorted part of the counts: its least and greatest key, and where its files begin."""

    low: int
    high: int
    path: str


def count_shards(spark: SparkSession, partials: DataFrame) -> tuple[list[Shard], dict[int, int]]:
    """Sums the counts of equal pairs into sorted shards; returns these and, for each first id, the highest count of its pairs."""
    folder = scratch_path(spark, "pair_counts")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"  # a repeated attempt writes its own files; the row that Spark keeps names one
        low = high = None
        best: dict[int, int] = {}
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        with system.open_output_stream(f"{base}/{name}.keys") as key_file, system.open_output_stream(f"{base}/{name}.counts") as count_file:

            def put(keys: np.ndarray, counts: np.ndarray) -> None:
                nonlocal low, high
                if len(keys):
                    key_file.write(keys.astype("<i8").tobytes())
                    count_file.write(counts.astype("<i8").tobytes())
                    low, high = int(keys[0]) if low is None else low, int(keys[-1])
                    first = keys >> 32
                    begin = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
                    for a, n in zip(first[begin].tolist(), np.maximum.reduceat(counts, begin).tolist(), strict=True):
                        best[a] = max(best.get(a, 0), n)

            for batch in batches:
                keys, counts = _summed(*(np.concatenate((held, batch.column(k).to_numpy())) for k, held in enumerate((keys, counts))))
                put(keys[:-1], counts[:-1])  # the last run may go on
                keys, counts = keys[-1:], counts[-1:]
            put(keys, counts)
        if low is not None:
            yield pa.RecordBatch.from_pydict(
                {"low": [low], "high": [high], "path": [f"{folder}/{name}"], "best": [list(best.items())]},
                schema=pa.schema([("low", pa.int64()), ("high", pa.int64()), ("path", pa.string()), ("best", pa.map_(pa.int64(), pa.int64()))]),
            )

    lined = partials.repartitionByRange("pair").sortWithinPartitions("pair")
    written = stored(lined.mapInArrow(write, "low long, high long, path string, best map<long, long>"), "shards")
    shards = sorted(Shard(*r) for r in written.select("low", "high", "path").collect())
    best = written.select(F.explode("best").alias("id", "n")).groupBy("id").agg(F.max("n"))
    return shards, dict(tuple(r) for r in best.collect())


@lru_cache(maxsize=256)
def _mapped(path: str) -> tuple[np.ndarray, np.ndarray] | None:
    system, base = _file_system(path)
    if not isinstance(system, fs.LocalFileSystem):
        return None
    return np.memmap(f"{base}.keys", "<i8", "r"), np.memmap(f"{base}.counts", "<i8", "r")


def _read(path: str) -> tuple[np.ndarray, np.ndarray]:
    system, base = _file_system(path)
    return tuple(np.frombuffer(system.open_input_stream(f"{base}.{kind}").read(), "<i8") for kind in ("keys", "counts"))


def looked_up(keys: np.ndarray, shards: list[Shard]) -> np.ndarray:
    """Counts of keys, which are sorted and all in some shard."""
    out = np.zeros(len(keys), dtype=np.int64)
    for shard in shards:
        i, j = np.searchsorted(keys, shard.low), np.searchsorted(keys, shard.high, side="right")
        if i < j:
            have, counts = _mapped(shard.path) or _read(shard.path)
            out[i:j] = counts[np.searchsorted(have, keys[i:j])]
    return out


class GroupText:
    """Writes groups as text: ids of one side joined by commas, sides by a bar, groups by semicolons."""

    def __init__(self, n_a: int, n_b: int):
        entries = [f"{i}{end}".encode() for i in range(n_a) for end in (",", "|")] + [f"{i}{end}".encode() for i in range(n_b) for end in (",", ";", "")]
        self.sizes = np.array([len(e) for e in entries], dtype=np.int64)
        self.letters = np.array(entries, dtype=f"S{self.sizes.max()}").view(np.uint8).reshape(len(entries), -1)
        self.b_at = 2 * n_a

    def __call__(self, s: Stretch, ends_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text, and its length up to each group's end; ``ends_doc`` tells of each group whether it is its document's last."""
        both = np.flatnonzero(s.marks == 3)
        a_upto, b_upto = np.cumsum(s.marks & 1, dtype=np.int64)[both], np.cumsum(s.marks >> 1, dtype=np.int64)[both]
        a_count, b_count = np.diff(a_upto, prepend=0), np.diff(b_upto, prepend=0)
        a_place = np.arange(len(s.a_ids)) + np.repeat(b_upto - b_count, a_count)
        b_place = np.arange(len(s.b_ids)) + np.repeat(a_upto, b_count)
        a_code, b_code = s.a_ids * 2, s.b_ids * 3 + self.b_at
        a_code[a_upto - 1] += 1
        b_code[b_upto - 1] += 1 + ends_doc
        codes = np.empty(len(s.a_ids) + len(s.b_ids), dtype=np.int64)
        codes[a_place], codes[b_place] = a_code, b_code
        text = self.letters[codes].ravel()
        return text[text != 0], np.cumsum(self.sizes[codes])[a_upto + b_upto - 1]


@lru_cache(maxsize=4)
def _group_text(n_a: int, n_b: int) -> GroupText:
    return GroupText(n_a, n_b)


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups ("a1,a2|b1;a3|b2,b3", empty without tokens).

    n_best links have a pair whose document count is the highest of its first id's pairs; count_sum adds up the counts of all links.
    """
    spark = docs.sparkSession
    tokens = stored(token_ids(docs, a_path, b_path, text), "token_ids")
    shards, best = count_shards(spark, stored(partial_counts(tokens, a_path, b_path), "partial_counts"))
    columns = pa.schema([(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups", pa.binary())])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_path, b_path)
        highest = np.zeros(len(pair.a_size), dtype=np.int64)
        highest[list(best)] = list(best.values())
        writer = _group_text(len(pair.a_size), len(pair.b_size))
        for batch in batches:
            for x, y, a_ids, a_bounds, b_ids, b_bounds in _slices(batch, pair.dtype):
                n = y - x
                n_groups, n_links, n_best, count_sum = (np.zeros(n, dtype=np.int64) for _ in range(4))
                texts: list[list[bytes]] = [[] for _ in range(n)]
                for s in stretches(a_ids, b_ids, pair.a_size, pair.b_size):
                    links = links_of(s, a_bounds)
                    keys, at = np.unique(links.keys, return_inverse=True)
                    counts = looked_up(keys, shards)[at]
                    is_best = counts == highest[links.keys >> 32]
                    here, begin = np.unique(links.docs, return_index=True)
                    n_links[here] += np.diff(begin, append=len(links.docs))
                    n_best[here] += np.add.reduceat(is_best.astype(np.int64), begin)
                    count_sum[here] += np.add.reduceat(counts, begin)
                    groups = np.flatnonzero(s.marks == 3)
                    stops = np.append(begin[1:], len(links.docs)) - 1  # each document's last link here ends a group
                    until = np.searchsorted(groups, stops) + 1
                    n_groups[here] += np.diff(until, prepend=0)
                    ends_doc = np.zeros(len(groups), dtype=np.int64)
                    ends_doc[until - 1] = 1
                    ends_doc[-1] = a_bounds[here[-1]] == s.a_from + len(s.a_ids)  # or goes on in the next stretch
                    letters, upto = writer(s, ends_doc)
                    place = 0
                    for d, stop in zip(here.tolist(), upto[until - 1].tolist(), strict=True):
                        texts[d].append(letters[place:stop].tobytes())
                        place = stop
                rows = [np.diff(a_bounds, prepend=0), np.diff(b_bounds, prepend=0), n_groups, n_links, n_best, count_sum]
                arrays = [pa.array(r) for r in rows] + [pa.array([b"".join(t) for t in texts], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, n), *arrays], names=["doc_id", *columns.names])

    out = tokens.mapInArrow(of_batches, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups binary")
    return out.withColumn("groups", F.col("groups").cast("string"))
