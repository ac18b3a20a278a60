"""Line dedup: lines that several documents share stay only in the first document.

Texts are split at newlines, lines are normalised and hashed (128 bits), and
per hash the number of distinct documents is compared with a threshold.  Lines
over it are dropped everywhere but in the smallest doc_id, and the others are put
together again by position.  Only hashes, ids and positions are shuffled for
that; each text moves once, to meet the positions that it loses.

Defined cases: a null or empty text is one empty line.  A repeated row is the
same document again and loses the same lines; it is reported as often as it
comes.  A line that one document repeats counts as one document's.  Rows without
doc_id are one document, which ranks above all others.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, stored

MIN_CODE_POINTS = 10
MIN_DOCUMENTS = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "' \\t\\n\\u000b\\f\\r'"


def lower_ascii(text: str) -> str:
    """SQL for A-Z lower-cased and nothing else; lower() does that at once where all is ASCII."""
    return f"if(length({text}) = octet_length({text}), lower({text}), translate({text}, '{_UPPER}', '{_LOWER}'))"


def line_keys(lines: str) -> str:
    """SQL for the normalised keys of an array of lines: blanks stripped at both ends, A-Z lower-cased."""
    return f"transform({lines}, l -> trim(BOTH {_SPACE} FROM l))"


def line_dedup(docs: DataFrame, text: str = "text", min_code_points: int = MIN_CODE_POINTS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped and kept_text."""
    body = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("body"))
    body = body.withColumn("doc", F.coalesce("doc_id", F.lit((1 << 63) - 1))).withColumn("copy", F.xxhash64("body"))
    keys = line_keys(f"split({lower_ascii('body')}, chr(10), -1)")
    keyed = body.select("doc", "copy", F.expr(f"posexplode({keys})").alias("at", "line_key")).where(F.length("line_key") >= min_code_points)
    keyed = keyed.select("doc", "copy", "at", F.xxhash64("line_key").alias("h1"), F.xxhash64(F.lit(7), "line_key", F.length("line_key")).alias("h2"))
    if min_documents == 2:  # at least two documents hold it if its least and its greatest differ: no distinct is needed
        shared = keyed.groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), F.count(F.lit(1)).alias("rows")).where("first_doc < last_doc")
    else:
        once = keyed.groupBy("h1", "h2", "doc").agg(F.count(F.lit(1)).alias("rows"))
        shared = once.groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"), F.count(F.lit(1)).alias("n_docs"), F.sum("rows").alias("rows")).where(F.col("n_docs") >= min_documents)
    shared = stored(shared.select("h1", "h2", "first_doc", "rows"), "shared_lines")
    lost = lookup(keyed, shared, ["h1", "h2"], ["first_doc"], "rows", F.struct("doc", "at")).where("first_doc <> doc")
    lost = lost.groupBy("doc", "copy").agg(F.collect_set("at").alias("lost"))  # at most a document's own lines
    out = body.join(lost, ["doc", "copy"], "left").withColumn("lines", F.expr("split(body, chr(10), -1)"))
    keep = "if(lost is null, lines, transform(array_except(sequence(0, size(lines) - 1), lost), i -> lines[i]))"
    return out.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(F.expr(keep), "\n").alias("kept_text"),
    )
