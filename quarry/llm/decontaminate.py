"""Benchmark decontamination with DataFrame functions only.

Benchmark items become word windows; the windows' hashes form a set that is
broadcast after its size is checked.  One pass over the documents looks at every place of every
width at once: a bitmap of the windows' first and last words lets few places through, and only these are
hashed as windows, one row each.  The hash set picks those that may match, and the words
themselves are compared before a hit counts.  Hits are word spans, so spans or whole documents can be removed.

A set beyond BROADCAST_ROWS windows is joined by a shuffle instead: of (document, place, hash) rows alone.  The places
that match are gathered by document and meet the texts again, where their words are compared.

Words are runs of ASCII letters, digits and any characters beyond ASCII; A-Z
count as a-z.  A window is ``n`` consecutive words of an item, or the whole of a
shorter item; an item without words has none.

Defined cases: null or empty texts have no words and no hits.  A repeated row
(same doc_id, same text) is reported once.  Items with equal windows all count.
Null doc_ids are kept; items without item_id are used but not listed.  Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, rows_of, stored
from .line_dedup import lower_ascii

WINDOW = 13
#: Size of the bitmap of windows' ends; it decides on cost alone, never on results.
BITS = 1 << 16
_SEPARATORS = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: str) -> str:
    """SQL for the array of normalised words of a text column."""
    return f"array_remove(split(coalesce({lower_ascii(text)}, ''), '{_SEPARATORS}', -1), '')"


def benchmark_windows(benchmark: DataFrame, text: str = "text", n: int = WINDOW) -> DataFrame:
    """The distinct windows of the items: item_id, width, window (its words) and hash."""
    items = benchmark.select("item_id", F.expr(words_of(text)).alias("item_words")).where("size(item_words) > 0")
    items = items.withColumn("width", F.least(F.size("item_words"), F.lit(n)))
    starts = items.select("item_id", "width", "item_words", F.expr("explode(sequence(1, size(item_words) - width + 1))").alias("at"))
    windows = starts.select("item_id", "width", F.expr("slice(item_words, at, width)").alias("window")).distinct()
    return windows.withColumn("hash", F.xxhash64("window"))


def _ends(first: str, last: str) -> str:
    """SQL for the place in the bitmap of a window's first and last words."""
    return f"(xxhash64({first}, {last}) & {BITS - 1})"


def _bitmap(windows: DataFrame) -> str:
    """SQL for a constant array of BITS bits: those of the windows' ends are set."""
    place = F.expr(_ends("window[0]", "window[width - 1]"))
    words = windows.select((place / 64).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast({_ends('window[0]', 'window[width - 1]')} % 64 as int))").alias("bit"))
    found = {r["at"]: r["bits"] for r in words.groupBy("at").agg(F.expr("bit_or(bit)").alias("bits")).collect()}  # BITS / 64 rows at most
    return "cast(split('" + ",".join(str(found.get(i, 0)) for i in range(BITS // 64)) + "', ',') as array<bigint>)"


def _places(widths: list[int], bitmap: str) -> str:
    """SQL for the (width, start) of a document's windows, of all widths, that the bitmap lets through."""
    scans = []
    for width in widths:
        place = _ends("doc_words[i]", f"doc_words[i + {width - 1}]")
        hit = f"shiftright({bitmap}[cast({place} div 64 as int)], cast({place} % 64 as int)) & 1 = 1"
        starts = f"if(size(doc_words) < {width}, array(), sequence(0, size(doc_words) - {width}))"
        scans.append(f"transform(filter({starts}, i -> {hit}), i -> struct({width} as width, i as start))")
    return f"concat({', '.join(scans)})"


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = WINDOW, also_clean: bool = False) -> DataFrame:
    """Verified hits: doc_id, copy (the text's hash), n_words, start (from 0), width, item_id.

    With ``also_clean`` every document has at least one row, whose start is null where it has no hit.
    """
    windows = stored(benchmark_windows(benchmark, "text", n), "windows")
    widths = sorted(r[0] for r in windows.select("width").distinct().collect()) or [n]  # n values at most
    wanted = stored(windows.select("hash", "width").distinct(), "wanted").withColumn("wanted", F.lit(True))
    checked = windows.select("hash", "item_id", F.col("window").alias("seen"), F.lit(True).alias("hit"))
    body = docs.select("doc_id", F.xxhash64(text).alias("copy"), F.expr(words_of(text)).alias("doc_words"))
    rows = body.select("doc_id", "copy", "doc_words", F.expr(f"posexplode_outer({_places(widths, _bitmap(windows))})").alias("nth", "place"))
    rows = rows.select("doc_id", "copy", "doc_words", "nth", "place.width", "place.start").withColumn("seen", F.expr("slice(doc_words, start + 1, width)"))
    rows = rows.select("doc_id", "copy", F.size("doc_words").alias("n_words"), "nth", "width", "start", "seen", F.when(F.col("start").isNotNull(), F.xxhash64("seen")).alias("hash"))
    first = F.coalesce(F.col("nth"), F.lit(0)) == 0  # this row stays for n_words
    if max(wanted.count(), windows.count()) <= BROADCAST_ROWS:
        found = rows.join(F.broadcast(wanted), ["hash", "width"], "left").where(F.col("wanted") | first)
        found = found.withColumn("seen", F.when(F.col("wanted"), F.col("seen"))).join(F.broadcast(checked), ["hash", "seen"], "left")
    else:
        lean = rows.where("start is not null").select("doc_id", "copy", "hash", "width", "start").join(wanted, ["hash", "width"])
        marked = lean.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("width", "start", "hash")).alias("places"))  # at most a document's own windows
        marked = marked.select(F.col("doc_id").alias("marked_id"), F.col("copy").alias("marked_copy"), "places")
        again = body.join(marked, F.col("doc_id").eqNullSafe(F.col("marked_id")) & F.col("copy").eqNullSafe(F.col("marked_copy")), "left")
        again = again.select("doc_id", "copy", "doc_words", F.explode_outer("places").alias("place"))
        again = again.select("doc_id", "copy", F.size("doc_words").alias("n_words"), "place.*", F.expr("slice(doc_words, place.start + 1, place.width)").alias("seen"))
        found = again.join(checked, ["hash", "seen"], "left")
    if not also_clean:
        found = found.where("hit")
    return found.select("doc_id", "copy", "n_words", F.when(F.col("hit"), F.col("start")).alias("start"), "width", "item_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted ids of the items found), spans (of hit words)."""
    spans = contaminated_spans(docs, benchmark, text, n, also_clean=True)
    # a window's hits are first summed up to one row a start, with the items that it stands for
    starts = spans.groupBy("doc_id", "copy", "n_words", "start").agg(F.max(F.col("start") + F.col("width")).alias("stop"), F.collect_set("item_id").alias("items"))
    order = Window.partitionBy("doc_id", "copy").orderBy(F.col("start").asc_nulls_first())
    before = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = starts.withColumn("from", F.greatest("start", before))
    covered = covered.withColumn("fresh", F.greatest(F.col("stop") - F.col("from"), F.lit(0)))
    return covered.groupBy("doc_id", "copy").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.coalesce(F.sum("fresh"), F.lit(0)).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.collect_list(F.when(F.col("fresh") > 0, F.struct(F.col("from").alias("start"), "stop")))).alias("spans"),
    )


def is_contaminated(n_hit, n_words):
    """A document counts as contaminated from a twentieth of its words on."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = decontaminate(docs, benchmark).where(is_contaminated(F.col("n_hit"), F.col("n_words")))
    return rows_of(docs, [F.col("doc_id"), F.xxhash64("text")], stored(bad.select("doc_id", "copy"), "contaminated"), "left_anti")
