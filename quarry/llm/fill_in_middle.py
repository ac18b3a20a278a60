"""Fill-in-the-middle: a text cut at two places becomes prefix, suffix, middle with markers.

A text is decoded to an array of code points.  Every code point gets a class; where
neighbours differ lies a boundary.  The units of a text are the stretches between
boundaries: single code points, runs of one kind of character, or lines.  Two
ranks out of 0 .. n, drawn from a hash of the seed and the document's id, pick boundaries;
the pieces between them are re-encoded around the markers.

Defined cases: a null text counts as empty.  An empty text, one that holds a marker,
and one in ``plain_percent`` stay as they are (form "plain").  A null id hashes as an
empty one.  Bytes that are no UTF-8 count as a code point each and come out as they were.
A repeated row is cut each time, in the same places.  Memory is about 12 bytes a character of the longest text.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import text_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_KINDS = np.full(128, 3, dtype=np.uint8)  # 0 space, 1 digit, 2 letter (and all beyond ASCII), 3 other
_KINDS[[32, *range(9, 14)]] = 0
_KINDS[48:58] = 1
_KINDS[[*range(65, 91), *range(97, 123)]] = 2


def _code_points(points: np.ndarray) -> np.ndarray:
    return np.arange(len(points), dtype=np.uint32) & 1  # no two neighbours alike


def _runs(points: np.ndarray) -> np.ndarray:
    return np.where(points < 128, _KINDS[np.minimum(points, 127)], 2)


def _lines(points: np.ndarray) -> np.ndarray:
    ends = points == 10
    return np.cumsum(ends) - ends  # a line feed belongs to the line that it ends


CLASSES = {"code points": _code_points, "runs": _runs, "lines": _lines}


def code_points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), dtype="<u4")


def encoded(points: np.ndarray) -> bytes:
    return points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Places 0, ..., len(points) where units begin or end; n + 1 of them for n units."""
    if not len(points):
        return np.zeros(1, dtype=np.int64)
    classes = CLASSES[unit](points)
    return np.concatenate(([0], np.flatnonzero(classes[1:] != classes[:-1]) + 1, [len(points)]))


def draws(seed: int, key: str) -> list[int]:
    """Four unsigned 32-bit numbers of a document."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]


def fill_in_middle(
    docs: DataFrame, text: str = "text", key: str = "doc_id", unit: str = "code points", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20
) -> DataFrame:
    """Per row: the key, n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points, null where plain) and output."""
    columns = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])
    markers = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))

    def cut(name: str, body: bytes) -> tuple:
        points = code_points(body)
        at = boundaries(points, unit)
        n = len(at) - 1
        h1, h2, h3, h4 = draws(seed, name)
        if not body or h3 % 100 >= 100 - plain_percent or any(m in body for m in markers):
            return n, "plain", None, None, body
        first, second = at[sorted((h1 % (n + 1), h2 % (n + 1)))].tolist()
        prefix, middle, suffix = (encoded(points[a:b]) for a, b in ((0, first), (first, second), (second, len(points))))
        p, s, m = markers
        if h4 % 100 < spm_percent:
            return n, "spm", first, second - first, b"".join((s, suffix, p, prefix, m, middle))
        return n, "psm", first, second - first, b"".join((p, prefix, s, suffix, m, middle))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, bodies in text_slices(batch.column(2)):
                names = batch.column(1).slice(a, b - a).to_pylist()
                rows = [cut(name, body or b"") for name, body in zip(names, bodies, strict=True)]
                arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), columns, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *arrays], names=["key", *columns.names])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), F.col(text).cast("binary").alias("body"))
    kind = docs.schema[key].dataType.simpleString()
    out = rows.mapInArrow(of_batches, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.select(F.col("key").alias(key), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; a text that holds no marker can be parted at the first of each."""

    def between(begin: str, end: str | None) -> Column:
        start = F.instr(output, begin) + len(begin)
        length = F.instr(output, end) - start if end else F.char_length(output)
        return F.substring(output, start, length)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
