"""Toxicity by class-conditional Kneser-Ney models.

Two models of the letters of words, one of toxic and one of ordinary documents,
give each letter a probability after the letters before it in its word.  A class's own
counts of ``ORDER``-letter runs (in how many of its documents each occurs) are discounted, and what the discount frees goes
to the next shorter run, whose Kneser-Ney continuation counts both classes share; so
an expression that a class has seen rarely is smoothed by what the whole corpus knows.

Counting runs in Spark over every training document: tasks add up the runs of their
rows, and the sums, the continuation counts of all lower orders and the
probabilities are groupings and joins of count tables, which grow with the corpus.
A run that neither class has seen gets what each class's discounts free after its context, so the ratio of these;
a context that a class hasn't seen frees everything.  So the table has an entry for each run and one for each context.

Scoring looks up the log-likelihood ratio of every run of every document.  A table of up to
``broadcast_runs`` runs (16 bytes each) is broadcast whole.  A larger one stays distributed: each
different word is spelled once and joined with the runs, and the words of each document are joined
with the words' sums; hot words are salted.  Both ways use all runs and give the same measures.

A document is compared by its length-normalised log-likelihoods as a whole, and by those of its
most suspicious words.  A logistic curve turns these into a score; it is fitted on a bounded
sample of training rows, measured by the counts of all others.  Then the sample is counted
too, so scores rest on every training document.

Defined cases: null and empty texts get the score of a document without evidence.  Without
labels of both classes every score is the share of toxic rows, or 0.5 without labels.
Labels may repeat or be null; null labels are not used.  Rows without doc_id
are scored like others and train nothing.  Repeated rows are scored as often as they
come.  Texts of any length are read a piece at a time; only a stretch without blanks and most punctuation is
never cut.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lookup, stored
from .labelled import by_hash, fit_logistic, fold
from .words import PIECE, WordTable, mix64, pieces, text_slices

ORDER = 6
#: Discounts of counts of one, two, and three or more in a class; and of continuation counts.
DISCOUNTS = (1.0, 1.25, 1.5)
DISCOUNT = 0.75
#: A table of more runs is joined instead of broadcast.
BROADCAST_RUNS = 4_000_000
CALIBRATION_ROWS = 6000
#: Texts of a slice when runs are counted: their numbers have 16 bits.
MOST_TEXTS = 1 << 16
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7


def letter_runs(texts: list[str | None]) -> tuple[np.ndarray, WordTable, np.ndarray]:
    """The run of ORDER bytes that ends at each byte of each word, as one integer; bytes before the word are 0.

    Words are those between anything but letters and digits, in lower case; each ends in a byte 1.
    """
    table = WordTable([None if t is None else t.lower() for t in texts], "alnum")
    lengths = table.end - table.start + 1
    stops = np.cumsum(lengths)
    begins = stops - lengths
    letters = np.ones(int(stops[-1]) if len(stops) else 0, dtype=np.uint64)
    inside = np.ones(len(letters), dtype=bool)
    inside[stops - 1] = False
    source = np.repeat(table.start - begins, lengths)
    positions = np.arange(len(letters))
    letters[inside] = table.raw[(positions + source)[inside]]
    place = positions - np.repeat(begins, lengths)
    runs = letters.copy()
    for back in range(1, ORDER):
        earlier = np.zeros_like(letters)
        earlier[back:] = letters[:-back] if back < len(letters) else 0
        earlier[place < back] = 0
        runs |= earlier << np.uint64(8 * back)
    return runs, table, lengths


def long_texts(texts: list[str | None]) -> dict[int, str]:
    """The texts too long to be looked at whole, by their numbers: they are taken in ``pieces`` that end between words."""
    return {i: t for i, t in enumerate(texts) if t is not None and len(t) > 4 * PIECE}


def distinct_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of each text: its number, the word's hash, its letters and its end, and how often it occurs there."""
    long, parts = long_texts(texts), []
    whole = [None if i in long else t and t.lower() for i, t in enumerate(texts)]
    for numbers, some in [(np.arange(len(texts)), whole), *((np.array([i]), [piece.lower()]) for i, t in long.items() for piece in pieces(t, "caseless"))]:
        table = WordTable(some, "alnum")
        owner = np.repeat(numbers, np.diff(table.bounds))
        parts.append(_added(owner, table.hashes, table.end - table.start + 1, np.ones(len(owner), dtype=np.int64)))
    return _added(*(np.concatenate(columns) for columns in zip(*parts, strict=True))) if long else parts[0]


def _added(owner: np.ndarray, word: np.ndarray, size: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((word, owner))
    owner, word, size, n = owner[order], word[order], size[order], n[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(owner) != 0) | (word[1:] != word[:-1])
    at = np.flatnonzero(new)
    return owner[at], word[at], size[at], np.add.reduceat(n, at) if len(at) else n


def run_counts(docs: DataFrame, text: str) -> DataFrame:
    """run, toxic, ordinary: counts over all rows of ``docs`` (text, is_toxic)."""

    def counted(run: np.ndarray, is_toxic: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (run, is_toxic, n)], names=["run", "is_toxic", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), dtype=np.int64)
            for a, b, texts in text_slices(batch.column(0), 1 << 21, MOST_TEXTS):
                long = long_texts(texts)
                for i, t in long.items():
                    seen = np.zeros(0, dtype=np.uint64)
                    for piece in pieces(t, "caseless"):
                        seen = np.union1d(seen, letter_runs([piece])[0])
                    yield counted(seen, np.full(len(seen), toxic[a + i]), np.ones(len(seen)))
                runs, table, lengths = letter_runs([None if i in long else t for i, t in enumerate(texts)] if long else texts)
                owner = np.repeat(np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(table.bounds)), lengths)
                once = np.unique(runs << np.uint64(16) | owner)
                owner = toxic[a:b][(once & np.uint64(0xFFFF)).astype(np.int64)]
                keys, counts = np.unique(once >> np.uint64(16) << np.uint64(1) | owner.astype(np.uint64), return_counts=True)
                yield counted(keys >> np.uint64(1), keys & np.uint64(1), counts)

    rows = docs.select(text, F.col("is_toxic").cast("int").alias("is_toxic")).mapInArrow(count, "run long, is_toxic long, n long")
    return rows.groupBy("run").agg(F.sum(F.col("n") * F.col("is_toxic")).alias("toxic"), F.sum(F.col("n") * (1 - F.col("is_toxic"))).alias("ordinary"))


def shared_backoff(counts: DataFrame) -> DataFrame:
    """run and p: its last byte's Kneser-Ney probability after the bytes before it, by the counts of both classes together.

    The longest runs count as often as they occur, shorter ones by the number of different bytes before them.
    """
    levels = [counts.select("run", (F.col("toxic") + F.col("ordinary")).alias("n"))]
    for order in range(ORDER - 1, 0, -1):
        mask = (1 << (8 * order)) - 1
        levels.append(stored(levels[-1].groupBy(F.col("run").bitwiseAND(F.lit(mask)).alias("run")).agg(F.count(F.lit(1)).alias("n")), f"order{order}"))
    p = None
    context = F.shiftright("run", 8)
    for order, level in enumerate(reversed(levels), 1):
        sums = level.groupBy(context.alias("context")).agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("kinds"))
        joined = level.join(sums, context == F.col("context"))
        own = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("all_n")
        free = DISCOUNT * F.col("kinds") / F.col("all_n")
        if p is None:
            p = joined.select("run", (own + free / 256).alias("p"))
        else:
            shorter = p.select(F.col("run").alias("shorter"), F.col("p").alias("q"))
            suffix = F.col("run").bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1))
            p = joined.join(shorter, suffix == F.col("shorter")).select("run", (own + free * F.col("q")).alias("p"))
        p = stored(p, "p")
    return p


def ratios(counts: DataFrame) -> DataFrame:
    """(key, ratio): log toxic - log ordinary probability of a run's last byte after those before it.

    The key is a run that was seen, or a context with a last byte of 0: its ratio is that of the runs that were not seen after it.
    """
    context = F.shiftright("run", 8)

    def off(n: str):
        return F.when(F.col(n) >= 3, DISCOUNTS[2]).when(F.col(n) == 2, DISCOUNTS[1]).when(F.col(n) == 1, DISCOUNTS[0]).otherwise(0.0)

    per = [F.sum("toxic").alias("t_all"), F.sum("ordinary").alias("o_all"), F.sum(off("toxic")).alias("t_off"), F.sum(off("ordinary")).alias("o_off")]
    contexts = counts.groupBy(context.alias("context")).agg(*per)

    def probability(c: str, n: str):
        own = (F.col(n) - off(n)) / F.col(f"{c}_all")
        return F.when(F.col(f"{c}_all") > 0, own + F.col(f"{c}_off") / F.col(f"{c}_all") * F.col("p")).otherwise(F.col("p"))

    joined = counts.join(contexts, context == F.col("context")).join(shared_backoff(counts), "run")
    ratio = F.log(probability("t", "toxic") / probability("o", "ordinary"))
    free = lambda c: F.when(F.col(f"{c}_all") > 0, F.col(f"{c}_off") / F.col(f"{c}_all")).otherwise(1.0)
    unseen = contexts.select(F.shiftleft("context", 8).alias("key"), F.log(free("t") / free("o")).cast("float").alias("ratio"))
    return joined.select(F.col("run").alias("key"), ratio.cast("float").alias("ratio")).unionByName(unseen)


class RunTable:
    """Ratios by run: the runs' mixed keys (mix64 is one to one) in order, and where each range of their first bits begins."""

    def __init__(self, keys: np.ndarray, ratio: np.ndarray):
        mixed = mix64(keys)
        order = np.argsort(mixed)
        self.keys, self.ratio = mixed[order], ratio[order].astype(np.float32)
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        edges = np.arange((1 << (64 - int(self.shift))) + 1)
        bucket = (self.keys >> self.shift).astype(np.int64)
        self.starts = np.searchsorted(bucket, edges).astype(np.int32)

    def get(self, runs: np.ndarray) -> np.ndarray:
        """The ratio of each run; for one that was not seen that of its context, and 0 where that was not seen either."""
        out, found = self._find(runs)
        rest = np.flatnonzero(~found)
        out[rest] = self._find(runs[rest] >> np.uint64(8) << np.uint64(8))[0]
        return out

    def _find(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = mix64(runs)
        bucket = (wanted >> self.shift).astype(np.int64)
        at, stop = self.starts[bucket], self.starts[bucket + 1]
        out, known = np.zeros(len(runs), dtype=np.float32), np.zeros(len(runs), dtype=bool)
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            found = self.keys[at[open_]] == wanted[open_]
            out[open_[found]] = self.ratio[at[open_[found]]]
            known[open_[found]] = True
            open_ = open_[~found]
            at[open_] += 1
            open_ = open_[at[open_] < stop[open_]]
        return out, known


def collected(table: DataFrame) -> RunTable:
    """The table of runs on the driver; only for tables whose count is checked."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in batch.columns], names=["key", "ratio"])

    rows = table.select("key", "ratio").mapInArrow(pack, "key binary, ratio binary").collect()
    return RunTable(np.frombuffer(b"".join(r.key for r in rows), np.uint64), np.frombuffer(b"".join(r.ratio for r in rows), np.float32))


EVIDENCE = 8


def _parts(texts: list[str | None], ratio_of: RunTable) -> np.ndarray:
    """Of each text, what its pieces give each: sums of ratios and of letters, the three most suspicious words, the most suspicious
    one a letter, and how many words are above 3, above 6, and there at all."""
    runs, table, lengths = letter_runs(texts)
    value = ratio_of.get(runs)
    out = np.zeros((len(texts), 9))
    out[:, 2:6] = -np.inf
    if not len(lengths):
        return out
    begins = np.cumsum(lengths) - lengths
    per_word = np.add.reduceat(value.astype(np.float64), begins)
    for d in range(len(texts)):
        a, b = table.bounds[d], table.bounds[d + 1]
        if a == b:
            continue
        words, sizes = per_word[a:b], lengths[a:b]
        top = np.sort(np.partition(words, -3)[-3:] if len(words) > 3 else words)[::-1]
        out[d, 2 : 2 + len(top)] = top
        out[d, [0, 1, 5, 6, 7, 8]] = words.sum(), sizes.sum(), (words / sizes).max(), (words > 3).sum(), (words > 6).sum(), len(words)
    return out


def evidence(texts: list[str | None], ratio_of: RunTable) -> np.ndarray:
    """EVIDENCE measures of each text: length-normalised log-likelihood ratios of the whole, of its three most
    suspicious words and of the most suspicious one a letter, how many words are suspicious, and its length."""
    long = long_texts(texts)
    parts = _parts([None if i in long else t for i, t in enumerate(texts)] if long else texts, ratio_of)
    for i, text in long.items():
        for piece in pieces(text, "caseless"):
            one, other = parts[i].copy(), _parts([piece], ratio_of)[0]
            parts[i] = one + other
            parts[i, 2:5] = np.sort(np.concatenate((one[2:5], other[2:5])))[:2:-1]
            parts[i, 5] = max(one[5], other[5])
    some = parts[:, 8] > 0
    out = np.zeros((len(texts), EVIDENCE))
    total, size, first, second, third, best, above3, above6, words = parts[some].T
    second = np.where(second > -np.inf, second, first)
    third = np.where(third > -np.inf, third, second)
    out[some] = np.column_stack([total / size, first, second, third, best, np.log1p(above3), np.log1p(above6), np.log1p(words)])
    return np.clip(out, -20, 20)


_COLUMNS = [f"e{i}" for i in range(EVIDENCE)]


def evidence_by_broadcast(docs: DataFrame, text: str, table) -> DataFrame:
    """doc_id and measures of each row of ``docs``, by a broadcast RunTable."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                found = evidence(texts, table.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(found[:, i]) for i in range(EVIDENCE))], names=["doc_id", *_COLUMNS])

    return docs.select("doc_id", text).mapInArrow(measure, "doc_id long, " + ", ".join(f"{c} double" for c in _COLUMNS))


def evidence_by_join(docs: DataFrame, text: str, table: DataFrame) -> DataFrame:
    """The same by joins: runs meet the different words' spellings, and words' sums the words of each row."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(2)):
                row, doc = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                owner, word, size, n = distinct_words(texts)
                # each row of docs has one entry of no word, so that none is lost
                places = pa.array(np.concatenate((owner, np.arange(b - a))))
                none = np.zeros(b - a, dtype=np.int64)
                columns = [np.concatenate((x, none)) for x in (word.view(np.int64), size, n)]
                yield pa.RecordBatch.from_arrays([row.take(places), doc.take(places), *map(pa.array, columns)], names=["row", "doc_id", "word", "size", "n"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0)):
                long = long_texts(texts)
                for some in [[None if i in long else t for i, t in enumerate(texts)], *([piece] for t in long.values() for piece in pieces(t, "caseless"))]:
                    runs, found, lengths = letter_runs(some)
                    word, first = np.unique(found.hashes, return_index=True)
                    begins, size = (np.cumsum(lengths) - lengths)[first], lengths[first]
                    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    run = runs[np.repeat(begins, size) + at]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(word, size).view(np.int64)), pa.array(at), pa.array(run.view(np.int64))], names=["word", "at", "run"])

    body = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text)
    entries = stored(body.mapInArrow(words, "row long, doc_id long, word long, size long, n long"), "words")
    spelled = docs.select(text).mapInArrow(spell, "word long, at long, run long").groupBy("word", "at").agg(F.min("run").alias("key"))
    spelled = stored(spelled, "spelled")
    context = F.shiftleft(F.shiftright("key", 8), 8)
    sought = spelled.select("word", "at", F.explode(F.array(F.struct(F.lit(True).alias("exact"), "key"), F.struct(F.lit(False).alias("exact"), context.alias("key")))).alias("x")).select("word", "at", "x.exact", "x.key")
    frequent = sought.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).join(table.select("key", "ratio"), "key")
    each = lookup(sought, frequent, ["key"], ["ratio"], "rows", F.struct("word", "at")).groupBy("word", "at").agg(F.max(F.when(F.col("exact"), F.col("ratio"))).alias("seen"), F.max(F.when(~F.col("exact"), F.col("ratio"))).alias("unseen"))
    sums = each.groupBy("word").agg(F.sum(F.coalesce("seen", "unseen", F.lit(0.0)).cast("double")).alias("value"))
    used = entries.where("n > 0").groupBy("word").agg(F.count(F.lit(1)).alias("rows"))
    found = lookup(entries, sums.join(used, "word"), ["word"], ["value"], "rows", F.col("row"))
    down = Window.partitionBy("row").orderBy(F.when(F.col("n") > 0, F.col("value")).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("upto", F.sum("n").over(down))
    word = lambda value: F.when(F.col("n") > 0, value)
    least = F.min(word(F.col("value")))

    def top(k: int):  # the k-th largest of the row's words, repetitions counted; the least where there are fewer
        return F.coalesce(F.max(F.when((F.col("n") > 0) & (F.col("upto") >= k), F.col("value"))), least)

    def many(condition):
        return F.log1p(F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("double"))

    size = F.sum(F.col("n") * F.col("size"))
    measures = [
        F.when(size > 0, F.sum(word(F.col("n") * F.col("value"))) / size), top(1), top(2), top(3), F.max(word(F.col("value") / F.col("size"))),
        many(F.col("value") > 3), many(F.col("value") > 6), many(F.col("n") > 0),
    ]
    rows = found.groupBy("row", "doc_id").agg(*(m.alias(c) for c, m in zip(_COLUMNS, measures, strict=True)))
    clipped = [F.greatest(F.least(F.coalesce(c, F.lit(0.0)), F.lit(20.0)), F.lit(-20.0)).alias(c) for c in _COLUMNS]
    return rows.select("doc_id", *clipped)


def toxicity_scores(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD, calibration: int = CALIBRATION_ROWS, broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """One row per document: doc_id, held_out, score (likelihood of being toxic), predicted."""
    spark = docs.sparkSession
    known = labels.select("doc_id", "toxic").where("toxic is not null").where(fold(FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.max(F.col("toxic") == 1).alias("is_toxic"))
    known = stored(known, "known")
    share = known.agg(F.avg(F.col("is_toxic").cast("double"))).first()[0]
    # at most a quarter; toxic rows are few: each class gives up to half of the sample, weighted back below by their shares
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0)
    chosen = by_hash(sample.where("is_toxic"), calibration // 2, 1).unionByName(by_hash(sample.where("not is_toxic"), calibration // 2, 1))
    chosen = stored(chosen, "chosen")
    sampled = docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id")
    one_each = stored(sampled.groupBy("doc_id").agg(F.min(text).alias(text)), "one_each")  # as many rows as ids, however often they are repeated
    others = known.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    counts = stored(run_counts(docs.select("doc_id", text).join(others, "doc_id"), text), "runs")

    def measure_by(counts: DataFrame):
        table = stored(ratios(counts), "ratios")
        if table.count() > broadcast_runs:
            return lambda rows: evidence_by_join(rows, text, table), lambda: None
        shared = spark.sparkContext.broadcast(collected(table))
        return lambda rows: evidence_by_broadcast(rows, text, shared), shared.unpersist

    measured, done = measure_by(counts)
    rows = measured(one_each).join(F.broadcast(chosen), "doc_id").collect()  # bounded by calibration
    done()
    y = np.array([float(r.is_toxic) for r in rows])
    weights, mean, scale = None, np.zeros(EVIDENCE), np.ones(EVIDENCE)
    if len(rows) and 0 < y.sum() < len(y):
        x = np.array([[r[c] for c in _COLUMNS] for r in rows])
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        weights = fit_logistic((x - mean) / scale, y)
        weights[-1] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    every = counts.unionByName(run_counts(sampled, text)).groupBy("run").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    found = measure_by(stored(every, "runs"))[0](docs)
    if weights is None:
        score = F.lit(0.5 if share is None else float(share))
    else:
        linear = F.lit(float(weights[-1]))
        for i in range(EVIDENCE):
            linear = linear + (F.col(f"e{i}") - float(mean[i])) / float(scale[i]) * float(weights[i])
        score = 1 / (1 + F.exp(-linear))
    found = found.withColumn("score", score)
    return found.select("doc_id", F.coalesce(fold(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
