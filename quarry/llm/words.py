"""Vectorised word tables: many texts become one byte buffer, and NumPy finds
and hashes every word of it at once.  Runs inside Spark tasks, a batch of rows
at a time; memory is a small multiple of the batch's bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C17 | 3  # odd and 3 modulo 4, so that BASE - 1 holds one factor of two only
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20260401)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: True for bytes that separate words, by kind.
SEPARATORS = {
    "space": np.isin(np.arange(256), [32, *range(9, 14)]),
    "alnum": np.array([b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)]),
}
SEPARATORS["alnum"][65:91] = False  # A-Z are words too before lower-casing

#: Longer texts are hashed in pieces of about so many characters, and longer power tables are not kept.
PIECE = 1 << 20
_KEPT = 1 << 23
_powers: dict[str, np.ndarray] = {}


def _power_table(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = np.full(max(n, 1 << 20), _BASE if kind == "up" else _BASE_INVERSE, dtype=np.uint64)
        base[0] = 1
        have = np.multiply.accumulate(base)
        if n <= _KEPT:
            _powers[kind] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordTable:
    """Words of a list of texts (None counts as empty), in order.

    ``hashes[i]`` is a 64-bit hash of word i with A-Z lower-cased, and the words
    of text d are ``bounds[d]:bounds[d + 1]``.  ``raw`` keeps the original bytes.
    """

    def __init__(self, texts: list[str | None], kind: str = "space"):
        encoded = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        self.raw = np.frombuffer(b" ".join(encoded) + b" ", dtype=np.uint8)
        sizes = np.fromiter((len(e) for e in encoded), dtype=np.int64, count=len(encoded))
        self.text_start = np.concatenate(([0], np.cumsum(sizes + 1)))[: len(encoded)]
        self.text_size = sizes
        separator = SEPARATORS[kind][self.raw]
        change = np.flatnonzero(separator[1:] != separator[:-1]) + 1
        if len(separator) and not separator[0]:
            change = np.concatenate(([0], change))
        self.start, self.end = change[0::2], change[1::2]
        self.bounds = np.concatenate((np.searchsorted(self.start, self.text_start), [len(self.start)]))
        sums = np.empty(len(self.raw) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE_VALUES[_LOWER[self.raw]] * _power_table("up", len(self.raw)), out=sums[1:])
        hashes = (sums[self.end] - sums[self.start]) * _power_table("down", len(self.raw) + 1)[self.start]
        self.hashes = mix64(hashes + (self.end - self.start).astype(np.uint64))


_GAP = {"space": re.compile(r"[\x20\t-\r]"), "alnum": re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")}
#: Of "alnum" those at which Unicode's lower case doesn't look further (at ' . : ^ ` it does, for the final sigma): pieces can be lower-cased each.
_GAP["caseless"] = re.compile(r"[\x00-\x26\x28-\x2D\x2F\x3B-\x40\x5B-\x5D\x5F\x7B-\x7F]")


def pieces(text: str, kind: str) -> Iterator[str]:
    """The text in pieces of about PIECE characters that end between words; a word stays whole."""
    begin = 0
    while begin < len(text):
        gap = _GAP[kind].search(text, begin + PIECE)
        stop = gap.end() if gap else len(text)
        yield text[begin:stop]
        begin = stop


def word_hashes(texts: list[str | None], kind: str = "space") -> tuple[np.ndarray, np.ndarray]:
    """``hashes`` and ``bounds`` of a WordTable; of a very long text 8 bytes a word and one piece's table are held at once."""
    if sum(len(t or "") for t in texts) <= 4 * PIECE:
        table = WordTable(texts, kind)
        return table.hashes, table.bounds
    found = [np.concatenate([np.zeros(0, np.uint64), *(WordTable([p], kind).hashes for p in pieces(t or "", kind))]) for t in texts]
    return np.concatenate(found), np.concatenate(([0], np.cumsum([len(f) for f in found])))


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows of a sequence of at least n words."""
    total = np.full(len(hashes) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        factor = np.uint64((0xD1342543DE82EF95 * (2 * k + 1)) & _MASK | 1)
        total += mix64(hashes[k : len(hashes) - n + 1 + k] + np.uint64(k + 1)) * factor
    return mix64(total)


def distinct_shingles(texts: list[str | None], n: int = 5, kind: str = "space") -> tuple[np.ndarray, np.ndarray]:
    """The distinct (shingle hash, number of its text) of all texts, in the order of the hashes.

    A shingle is a window of n words, or all words of a text that has fewer.
    """
    hashes, bounds = word_hashes(texts, kind)
    words = np.diff(bounds)
    shingles, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for width in range(1, n + 1):
        which = np.flatnonzero(words >= n if width == n else words == width)
        if len(which):
            windows = words[which] - width + 1
            starts = np.repeat(bounds[which] - np.concatenate(([0], np.cumsum(windows)[:-1])), windows) + np.arange(windows.sum())
            shingles.append(shingle_hashes(hashes, width)[starts])
            owners.append(np.repeat(which, windows))
    h, owner = np.concatenate(shingles), np.concatenate(owners)
    order = np.argsort(h)
    h, owner = h[order], owner[order]
    again = np.zeros(len(h), dtype=bool)
    again[1:] = h[1:] == h[:-1]
    group = again.copy()
    group[:-1] |= again[1:]
    several = np.flatnonzero(group)  # rows whose hash occurs again: put their texts in order and drop repetitions
    if not len(several):
        return h, owner
    inner = several[np.lexsort((owner[several], h[several]))]
    owner[several] = owner[inner]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = ~again[1:] | (owner[1:] != owner[:-1])
    return h[keep], owner[keep]


def slice_bounds(column: pa.Array, most: int = 1 << 20, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of a column of texts of about ``most`` bytes and at most ``rows`` rows each; one text is never cut."""
    if not len(column):
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    upto = np.cumsum(sizes)
    begin = 0
    while begin < len(column):
        held = upto[begin] - sizes[begin]
        end = min(int(np.searchsorted(upto, held + most)) + 1, begin + rows, len(column))
        yield begin, end
        begin = end


def text_slices(column: pa.Array, most: int = 1 << 20, rows: int = 1 << 16) -> Iterator[tuple[int, int, list[str | None]]]:
    """The same with their texts: only one range's strings exist at a time."""
    for begin, end in slice_bounds(column, most, rows):
        yield begin, end, column.slice(begin, end - begin).to_pylist()
