"""The keyword automaton against one function a word, on random texts and hostile ones."""

import random
import re
import time

from pyspark.sql import functions as F

from quarry.functions.text import extract_patterns, mentions_any
from quarry.operators.keywords import Keywords


def table(spark, rows, column):
    return spark.createDataFrame([(r,) for r in rows], f"{column} string")


def samples(n=150):
    chance = random.Random(9)
    piece = lambda: chance.choice(["a", "b", "ab", "aa", ".", "\n", " ", "漢", "　", "\x85", "😀", "with "])
    words = sorted({"".join(piece() for _ in range(chance.randint(1, 3))) for _ in range(40)})
    texts = ["".join(piece() for _ in range(chance.randint(0, 60))) for _ in range(n)]
    return words, texts


def test_mentions_and_counts(spark):
    words, texts = samples()
    keys = Keywords(table(spark, [*words, *words[:5], "", None], "word"))
    got = table(spark, [*texts, None, ""], "t").select("t", keys.mentions(F.col("t")).alias("m"), keys.counts(F.col("t")).alias("c")).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        held = [w for w in words if w in (r.t or "")]
        assert r.m == held
        assert [(x.word, x.n) for x in r.c] == [(w, len(re.findall(f"(?={re.escape(w)})", r.t))) for w in held]


def test_the_same_as_one_function_a_word(spark):
    words, texts = samples()
    keys, t = Keywords(table(spark, words, "word")), F.col("t")
    patterns = [rf"\Q{w}\E[^.\n]*" for w in words]
    rows = table(spark, texts, "t").select("t", keys.phrases(t).alias("got"), extract_patterns(t, patterns).alias("want"), keys.mentions(t).alias("m"), mentions_any(t, words).alias("any"))
    found = rows.collect()
    assert any(r.got for r in found)
    for r in found:
        assert r.got == r.want, r.t
        assert bool(r.m) == r.any


def test_no_words_and_no_rows(spark):
    none = Keywords(table(spark, [], "word"))
    t = F.col("t")
    for r in table(spark, ["abc", None, ""], "t").select(none.mentions(t).alias("m"), none.counts(t).alias("c"), none.phrases(t).alias("p")).collect():
        assert (r.m, r.c, r.p) == ([], [], [])
    assert table(spark, [], "t").select(Keywords(table(spark, ["a"], "word")).mentions(t)).count() == 0


def test_a_thousand_times_the_words_cost_little(spark):
    """10,000 keywords take about the time of 10; a long text without any end is no trouble."""
    chance = random.Random(2)
    word = lambda: "".join(chance.choice("abcdefgh") for _ in range(9))
    texts = table(spark, [" ".join(word() for _ in range(2_000)) for _ in range(200)] + ["with x " * 100_000], "t").repartition(4).cache()
    texts.count()

    def seconds(n):
        keys = Keywords(table(spark, ["with", *(word() for _ in range(n))], "word"))
        plan = texts.select(F.size(keys.mentions(F.col("t"))).alias("n"), F.size(keys.phrases(F.col("t"))).alias("p"))
        plan.write.format("noop").mode("overwrite").save()  # the automaton has reached the workers
        began = time.perf_counter()
        plan.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    few, many = seconds(10), seconds(10_000)
    texts.unpersist()
    assert many < 3 * few + 1, (few, many)


def test_a_batch_is_not_held_as_python_objects():
    import tracemalloc

    import pyarrow as pa

    from quarry.operators.keywords import _by_slices

    texts = pa.array([None, *("x" * 4_000 for _ in range(8_000))])
    tracemalloc.start()
    found = _by_slices(texts, lambda t: [t[:2_000], "漢"] if t else [], pa.list_(pa.string()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 8_001 and found[0].as_py() == [] and found[8_000].as_py() == ["x" * 2_000, "漢"]
    assert peak < 4_000_000  # of 32 MB of texts
    assert _by_slices(texts.slice(0, 0), lambda t: [], pa.list_(pa.string())).type == pa.list_(pa.string())
