"""Dictionary segmentation against a plain recursion, and as the tokenizer of an index."""

import random
from functools import cache

from pyspark.sql import functions as F

from quarry.operators import lexical
from quarry.operators.segment import _word_costs, segmenter


def plain(text, costs, alone):
    @cache
    def best(i):
        if i == len(text):
            return 0, ()
        known = [(costs[text[i:j]] + best(j)[0], -(j - i)) for j in range(i + 1, len(text) + 1) if text[i:j] in costs]
        if text[i] not in costs:
            known.append((alone + best(i + 1)[0], -1))
        cost, length = min(known)
        return cost, (text[i : i - length], *best(i - length)[1])

    return list(best(0)[1])


def test_equals_a_plain_recursion(spark):
    chance = random.Random(4)
    pick = lambda n: "".join(chance.choice("機器學習課程") for _ in range(n))
    words = [(pick(chance.randint(1, 4)), chance.randint(1, 50)) for _ in range(60)] + [("", 5), (None, 5), ("機器", 0)]
    table = spark.createDataFrame(words, "word string, count long").where("word is null or word <> '課'")
    costs, alone = _word_costs(table)
    texts = [pick(chance.randint(1, 30)) for _ in range(200)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3).select("t", segmenter(table)(F.col("t")).alias("w")).collect()
    assert len(got) == 200
    for r in got:
        assert r.w == plain(r.t, costs, alone), r.t


def test_other_scripts_stay_whole_and_long_runs_end(spark):
    words = spark.createDataFrame([("機器", 5), ("學習", 5), ("機器學習", 9), ("大學", 3), ("大學生", 3), ("生活", 8)], "word string, count long")
    rows = [("機器學習 deep_learning, 大學生活!",), (None,), ("",), ("no han 12",), ("學習X機",), ("機器學習" * 20_000,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(segmenter(words)(F.col("t"))).collect()]
    assert got[:5] == [["機器學習", "deep_learning", "大學", "生活"], [], [], ["no", "han", "12"], ["學習", "X", "機"]]
    assert got[5] == ["機器學習"] * 20_000


def test_tokenizer_of_an_index(spark):
    words = spark.createDataFrame([("機器", 5), ("學習", 5), ("大學", 3), ("生活", 8)], "word string, count long")
    docs = spark.createDataFrame([(1, "機器學習"), (2, "大學生活"), (3, "學習生活"), (4, "其他"), (5, "其他"), (6, "大學")], "doc_id long, text string")
    index = lexical.write_index(docs, tokenizer=segmenter(words))
    hits = lexical.bm25_search(spark.createDataFrame([(1, "大學"), (2, "機器的學習"), (3, "器學")], "qid long, text string"), index, 5)
    assert sorted((r.qid, r.doc_id) for r in hits.collect()) == [(1, 2), (1, 6), (2, 1), (2, 3)]
