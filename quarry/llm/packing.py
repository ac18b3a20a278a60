"""Packing along a space-filling curve.

Each document becomes token ids and, from them, a vector of few dimensions: the
mean of one pseudo-random direction a token id (a projection of the hashed bag of
tokens).  The vector's place on a Hilbert curve is its key.  Documents are sorted
by range of (key, doc_id), so that neighbours on the curve meet in one partition,
ties included, and no key can fill a partition alone.  Each partition then lays its
documents end to end and cuts the row of ids into sequences.

Only the last sequence of a partition can be short; it is split into pieces whose
lengths are powers of two, which need no padding.  Memory is one batch of
documents and one open sequence, whatever the length of a text.

Defined cases: a null or empty text is the end id alone.  A repeated row is packed
as often as it comes.  A null doc_id sorts first.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .words import text_slices

SEQUENCE_TOKENS = 2048
DIMENSIONS, BITS = 4, 8
CACHED_WORDS = 800_000

_loaded: dict[str, "WordTokenizer"] = {}


#: Texts of these characters alone (ASCII, Latin-1 and Latin Extended-A) can be cut into pre-tokens here; they are stable under NFC.
_PLAIN = re.compile("[\t\n\r -~\u00a1-\u017f]*")
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_DIGITS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PRE_TOKEN = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_DIGITS}{_LETTERS}]+")


class WordTokenizer:
    """A tokenizer of lower-cased words that marks word ends, with a bounded cache of the ids of words.

    Pre-tokens of such a tokenizer are encoded one by one whatever stands around them, so a text's ids
    are those of its pre-tokens.  New ones are encoded together and parted at the ids that end
    a word.  Texts of other alphabets, or that may hold special tokens, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        size = self.model.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends_word = np.array([self.model.id_to_token(i).endswith("</w>") for i in range(size)])
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [_PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        cut = [_PRE_TOKEN.findall(t.lower()) if p else () for t, p in zip(texts, plain, strict=True)]
        new = list(set().union(*cut).difference(self.known))
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known = {}
            new = list(set().union(*cut))
        if new:
            ids = np.array(self.model.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            stops = (np.flatnonzero(self.ends_word[ids]) + 1) * self.dtype.itemsize
            if len(stops) == len(new):
                whole, begin = ids.tobytes(), 0
                for word, stop in zip(new, stops.tolist(), strict=True):
                    self.known[word] = whole[begin:stop]
                    begin = stop
            else:  # a vocabulary that can't end every word: one by one
                for word, e in zip(new, self.model.encode_batch_fast(new, add_special_tokens=False), strict=True):
                    self.known[word] = np.array(e.ids, dtype=self.dtype).tobytes()
        get = self.known.__getitem__
        return [b"".join(map(get, c)) if p else self.encode_whole(t) for t, c, p in zip(texts, cut, plain, strict=True)]

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()


def tokenizer_of(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The index on the Hilbert curve of each row of integer coordinates below 2**bits."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the rotations, from the largest cells on
        q, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    gray = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        gray ^= np.where((x[dims - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= gray
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def token_table(docs: DataFrame, tokenizer_path: str, text: str = "text", end_id: int = 1) -> DataFrame:
    """doc_id, curve_key, n_tokens and ids (little-endian, in the narrowest type that holds the vocabulary), end id last."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(tokenizer_path)
        directions = np.random.Generator(np.random.PCG64(7)).standard_normal((1 << 16, DIMENSIONS)).astype(np.float32)
        end = np.array([end_id], dtype=tokenizer.dtype).tobytes()
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                ids = [i + end for i in tokenizer.encode([t or "" for t in texts])]
                means = np.stack([directions[np.frombuffer(i, tokenizer.dtype) & 0xFFFF].mean(axis=0) for i in ids])
                cells = np.clip((np.tanh(means * 2) + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)
                sizes = [len(i) // tokenizer.dtype.itemsize for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(hilbert_keys(cells), pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "curve_key", "n_tokens", "ids"],
                )

    return docs.select("doc_id", text).mapInArrow(encode, "doc_id long, curve_key long, n_tokens long, ids binary")


def powers_of_two(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", length: int = SEQUENCE_TOKENS, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit)."""
    tokens = stored(token_table(docs, tokenizer_path, text, end_id), "tokens")
    narrow = tokenizer_of(tokenizer_path).dtype
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # pieces of the open sequence: doc_id, start, doc_tokens, ids
        filled = 0
        rows: list[tuple] = []

        def close(sizes: list[int]) -> None:
            nonlocal sequence, held, filled
            room, offset = sizes[0], 0
            sizes = sizes[1:]
            for doc, start, total, ids in held:
                while len(ids):
                    part = ids[:room]
                    rows.append((doc, start, len(part), total, sequence, offset, part.astype("<u4").tobytes()))
                    start, ids, room, offset = start + len(part), ids[len(part) :], room - len(part), offset + len(part)
                    if not room:
                        sequence, offset = sequence + 1, 0
                        room = sizes.pop(0) if sizes else 0
            held, filled = [], 0

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            for doc, total, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids, start = np.frombuffer(ids.as_buffer(), dtype=narrow), 0
                while start < total:
                    part = ids[start : start + length - filled]
                    held.append((doc, start, total, part))
                    start, filled = start + len(part), filled + len(part)
                    if filled == length:
                        close([length])
                    if len(rows) >= 1000:
                        yield batch_of()
        if filled:
            close(powers_of_two(filled))
        if rows:
            yield batch_of()

    along = tokens.repartitionByRange("curve_key", "doc_id").sortWithinPartitions("curve_key", "doc_id", "n_tokens", F.xxhash64("ids"), "ids")  # a repeated task cuts the same pieces
    return along.select("doc_id", "n_tokens", "ids").mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
