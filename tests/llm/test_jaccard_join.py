import random

import numpy as np
import pytest

from quarry.llm import jaccard_join, words
from quarry.llm.jaccard_join import jaccard_classes, join_cell, keep_one_of_near


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out


def brute(rows, n=5):
    """(doc_id, set size, class) of each row; rows with one doc_id are one document, those without one are each their own."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same or sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(str((doc, len(s), least.get(root(i)))) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def found(docs):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard_classes(docs).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["ÉCOLE", "École", "a"]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 30, 60, 200]))] for _ in range(8)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.7 else [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(0, 1 + len(w) // 25)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            w = passage + w[: rng.randrange(0, 12)]
        text = " ".join(w) if rng.random() < 0.8 else "\n ".join(w).upper()
        rows.append((i * 3 + 1, text))
    return [*rows, (0, None), (2, ""), (5, " \t"), (8, "one"), (11, "ONE"), (14, rows[0][1])]


@pytest.mark.parametrize("small", [False, True])
def test_classes_match_brute_force(spark, monkeypatch, small):
    if small:  # slices of a few documents, and rounds of pivots, regions and blocks over cells of over seven members
        monkeypatch.setattr(jaccard_join, "CELL_MEMBERS", 7)
        monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
        monkeypatch.setattr(jaccard_join, "SLICE_BYTES", 900)
        monkeypatch.setattr(jaccard_join, "MESSAGE_SHINGLES", 40)
        monkeypatch.setattr(jaccard_join, "SLICE_DOCUMENTS", 6)
        monkeypatch.setattr(words, "PIECE", 100)
    rows = corpus(4, 250)
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], "doc_id long, text string, member string, n_shingles int, row int, cell int").repartition(5)
    assert found(docs) == brute(rows)


def test_a_family_that_is_not_one_class(spark, monkeypatch):
    """Many documents near the threshold: regions that windows shrink and some that they don't."""
    monkeypatch.setattr(jaccard_join, "CELL_MEMBERS", 8)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 2)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for k in rng.sample(range(12), rng.randrange(1, 4)):
            w[5 * k] = f"x{rng.randrange(3)}"
        rows.append((i, " ".join(w)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_recursion_is_exact():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 1 << 60, 80).astype(np.uint64) for _ in range(6)]
    sets = []
    for _ in range(300):
        s = base[rng.integers(6)].copy()
        k = rng.integers(0, 14)
        s[rng.integers(0, 80, k)] = rng.integers(0, 1 << 60, k).astype(np.uint64)
        sets.append(np.unique(s))
    sizes = np.array([len(s) for s in sets])
    want = join_cell(sets, sizes, 80, leaf=1000)
    assert (join_cell(sets, sizes, 80, leaf=8) == want).all()
    known = np.where(np.arange(300) % 7 == 0, want + 1000, np.arange(300))
    assert (join_cell(sets, sizes, 80, leaf=8, known=known) == want).all()


def test_rows_are_told_apart_by_text_not_by_id(spark):
    v = [f"v{i}" for i in range(60)]
    a, b, c = " ".join(v), " ".join(f"u{i}" for i in range(60)), " ".join(f"t{i}" for i in range(60))
    near = b + " more"
    rows = [(3, a), (5, a), (5, b), (7, near), (-1, c), (None, c + " x"), (None, near + " yet"), (None, "alone here"), (None, "alone here"), (None, None), (9, "other words"), (9, "other words"), (10, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(docs) == brute(rows)
    kept = sorted((str(r.doc_id), r.text or "") for r in keep_one_of_near(docs).collect())
    assert kept == sorted([("3", a), ("5", b), ("-1", c), ("None", "alone here"), ("None", ""), ("9", "other words"), ("10", ""), ("10", "")])


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_classes(none).count() == 0 and keep_one_of_near(none).count() == 0
    text = " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(3, text), (3, text), (None, text), (9, "other words"), (10, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in jaccard_classes(docs).collect()) == [(0, 3), (3, 3), (3, 3), (9, 9), (10, 10)]
    assert sorted(r.doc_id for r in keep_one_of_near(docs).collect()) == [3, 9, 10]


def test_columns_of_any_name_and_type_stay(spark):
    names = "doc_id long, text string, kept_doc_id int, k0 int, whole map<string,int>, row int, `a.b` int"
    docs = spark.createDataFrame([(i, "one text of several words here", 1, 2, {"x": 1}, 3, 4) for i in range(4)], names)
    out = keep_one_of_near(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(0, "one text of several words here", 1, 2, {"x": 1}, 3, 4)]


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bcd", "É", "longer-word"]) for _ in range(k)) for k in (0, 1, 4, 5, 300)] + [None, "x" * 500 + " y"]
    whole = [x.tolist() for x in words.distinct_shingles(texts)]
    monkeypatch.setattr(words, "PIECE", 16)
    assert [x.tolist() for x in words.distinct_shingles(texts)] == whole
