"""Operators against plain versions: Kneser-Ney ratios, nested quotes, hostile pages, and tables beyond a broadcast."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import decontaminate as decontaminate_module
from quarry.llm import quotations, toxicity
from quarry.llm.decontaminate import decontaminate, without_contaminated
from quarry.llm.exact_dedup import keep_one_of_equal
from quarry.llm.html_text import visible_text
from quarry.llm.jaccard_join import keep_one_of_near
from quarry.llm.quality import quality_scores, without_rejected
from quarry.llm.quotations import link_quotes
from quarry.llm.toxicity import ORDER, ratios, run_counts
from tests.llm.test_native_operators import contamination_plain

# ---- toxicity --------------------------------------------------------------------------------------------------


class PlainKneserNey:
    """The two models over bytes, written as their definition: dictionaries and a recursion."""

    def __init__(self, docs):
        self.n = {True: Counter(), False: Counter()}
        for text, toxic in docs:
            runs = set()
            for word in re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower()):
                raw = b"\0" * (ORDER - 1) + word.encode() + b"\1"
                runs |= {raw[i : i + ORDER] for i in range(len(raw) - ORDER + 1)}
            self.n[toxic].update(runs)
        levels = {ORDER: self.n[True] + self.n[False]}
        for k in range(ORDER - 1, 0, -1):
            levels[k] = Counter(run[1:] for run in levels[k + 1])
        self.tables = {}
        for k, level in levels.items():
            sums = defaultdict(lambda: [0, 0])
            for run, n in level.items():
                sums[run[:-1]][0] += n
                sums[run[:-1]][1] += 1
            self.tables[k] = level, sums

    def shared(self, run):
        k = len(run)
        if k == 0:
            return 1 / 256
        level, sums = self.tables[k]
        total, kinds = sums.get(run[:-1], (0, 0))
        q = self.shared(run[1:])
        return max(level[run] - 0.75, 0) / total + 0.75 * kinds / total * q if total else q

    def of_class(self, run, toxic):
        off = lambda n: (0, 1.0, 1.25, 1.5)[min(n, 3)]
        after = {r: n for r, n in self.n[toxic].items() if r[:-1] == run[:-1]}
        total = sum(after.values())
        p = self._lower(run)
        return (self.n[toxic][run] - off(self.n[toxic][run])) / total + sum(map(off, after.values())) / total * p if total else p

    def _lower(self, run):
        """What discounts go to: the shared model at the full order."""
        return self.shared(run)


def test_ratios_of_seen_and_unseen_runs(spark):
    rng = random.Random(2)
    docs = [("".join(rng.choice("abc ") for _ in range(30)), i % 3 == 0) for i in range(40)] + [("é", True), ("", False)]
    plain = PlainKneserNey(docs)
    frame = spark.createDataFrame(docs, "text string, is_toxic boolean").repartition(3)
    found = {int(r.key): r.ratio for r in ratios(run_counts(frame, "text")).collect()}
    keys = np.array(list(found), dtype=np.int64).view(np.uint64)
    table = toxicity.RunTable(keys, np.array(list(found.values()), dtype=np.float32))
    seen = list(plain.n[True] + plain.n[False])
    contexts = [r[:-1] for r in seen[:40]] + [b"\0zzzz", b"zzzzz"]
    asked = seen + [c + b for c in contexts for b in (b"a", b"z", b"\1")]
    got = table.get(np.array([int.from_bytes(r, "big") for r in asked], dtype=np.uint64))
    want = [math.log(plain.of_class(r, True) / plain.of_class(r, False)) for r in asked]
    assert np.allclose(got, want, atol=1e-4)
    for context in contexts:  # each class's probabilities after a context sum to one
        for toxic in (True, False):
            assert abs(sum(plain.of_class(context + bytes([b]), toxic) for b in range(256)) - 1) < 1e-9


def test_more_texts_than_numbers_of_a_slice(spark, monkeypatch):
    docs = spark.createDataFrame([("ab" if i % 2 else "b", i % 3 == 0) for i in range(50)], "text string, is_toxic boolean").coalesce(1)
    want = sorted(tuple(r) for r in run_counts(docs, "text").collect())
    monkeypatch.setattr(toxicity, "MOST_TEXTS", 7)
    assert sorted(tuple(r) for r in run_counts(docs, "text").collect()) == want


def test_samples_are_bounded_by_rows(spark):
    """One doc_id on many rows is one row of a sample, and all of them count."""
    rows = [(1, f"bad word number {i}") for i in range(300)] + [(i, f"fine words {i} of a text") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i != 1), int(i == 1)) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    assert quality_scores(docs, labels).count() == len(rows) and toxicity.toxicity_scores(docs, labels).count() == len(rows)


# ---- quotations ------------------------------------------------------------------------------------------------


def plain_quotes(rows):
    """(conv_id, turn): parent, number of quoted runs and of linked ones, for messages whose quotes are single lines or whole passages."""
    own, out = defaultdict(set), {}
    norm = lambda s: re.sub(r"\s+", " ", s).strip().lower()

    def runs_of(text):
        runs, last = [], None
        for line in text.split("\n"):
            m = re.match(r"((?:[ \t]*>)*) ?(.*)", line) if line.lstrip().startswith(">") else re.match("()(.*)", line)
            level, words = m[1].count(">"), norm(m[2])
            if not words:
                last = None
                continue
            if last != level:
                runs.append((level, []))
            runs[-1][1].append(words)
            last = level
        return runs

    for conv, turn, _, text in rows:
        for level, lines in runs_of(text):
            if level == 0 and conv is not None:
                own[conv, turn] |= {*lines, " ".join(lines)}
    for conv, turn, _, text in rows:
        votes, quotes, linked = {}, 0, 0
        for level, lines in runs_of(text):
            if level == 0:
                continue
            quotes += 1
            hit = False
            for whole, part in [(0, x) for x in lines] + ([(1, " ".join(lines))] if len(lines) > 1 else []):
                origin = max((t for c, t in own if c == conv and t < turn and part in own[c, t]), default=None)
                if origin is not None:
                    hit = True
                    if level == 1:
                        v = votes.setdefault(origin, [0, 0, 0, 0])
                        long = len(part) >= quotations.MIN_LINE
                        v[0], v[1], v[2], v[3] = max(v[0], whole * long), v[1] + len(part) * long, max(v[2], whole), v[3] + len(part)
            linked += hit
        out[conv, turn] = max(((*v, o) for o, v in votes.items()), default=(None,))[-1], quotes, linked
    return out


@pytest.mark.parametrize("span", [1024, 3])
def test_nested_quotes(spark, monkeypatch, span):
    monkeypatch.setattr(quotations, "SPAN", span)
    rng = random.Random(6)
    pool = ["ok", "Thanks a lot", "The first long line of it", "a second line here", "É voilà"]
    rows = []
    for conv in range(4):
        texts = []
        for turn in range(25):
            lines = []
            for _ in range(rng.randrange(0, 3)):
                if texts:
                    source = rng.choice(texts).split("\n")
                    lines += ["> " + x for x in source[: rng.randrange(1, 4)]] + [""]
            lines += [rng.choice(pool) + rng.choice(["", f" {turn}"]) for _ in range(rng.randrange(0, 3))]
            texts.append("\n".join(lines))
            rows.append((conv, turn, "user", texts[-1]))
    got = {(r.conv_id, r.turn): (r.parent_turn, r.n_quotes, r.n_linked) for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = plain_quotes(rows)
    assert got == want and sum(x[0] is not None for x in want.values()) > 20


def test_rows_without_conversation_or_turn_are_not_linked(spark):
    rows = [(None, 0, "user", "some words of a text"), (None, 1, "user", "> some words of a text\nyes"), (1, None, "user", "some words of a text"), (1, 5, "user", "> some words of a text\nno")]
    got = sorted((str(r.conv_id), str(r.turn), r.parent_turn, r.n_quotes, r.n_linked) for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert got == [("1", "5", None, 1, 0), ("1", "None", None, 0, 0), ("None", "0", None, 0, 0), ("None", "1", None, 1, 0)]


# ---- HTML ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page",
    ["<a " * 80000, "<div>" * 40000 + "<p>" * 40000, '<a "x>" ' * 40000, "<a '" * 60000 + ">", "<b>x</b>" * 60000, "<!x" * 80000, "<script></script " * 20000, "<ul><li>" * 20000 + "x", "<svg>" + "<g>" * 40000 + "<desc>" * 9000,
     "<table><tr>" + "<td>x" * 20000 + "<tr><td>y" * 20000, "<p><button>" + "<div>" * 30000 + "<p>" * 30000, "<td colspan=1000>" * 5000],
)
def test_hostile_pages_take_time_in_proportion(page):
    began = time.perf_counter()
    out = visible_text(page)
    assert time.perf_counter() - began < 15 and len(out) < 60 * len(page)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td rowspan=2>a<td colspan=2>b<td>c<tr><td>d<td>e<td>f</table>", "a | b |   | c\n  | d | e | f"),
        ("<table><tr><th rowspan=3>x<th>1<tr><td>2<tr><td>3<tr><td>y<td>4</table>", "x | 1\n  | 2\n  | 3\ny | 4"),
        ('<p title="a > b">text', "text"),
        ("<p>one <b title='never closed>two</b> three", "one two three"),
        ("x <a href=y", "x <a href=y"),
        ("<p>a<!-- never closed <p>b", "a"),
    ],
)
def test_spans_and_unclosed_tags(page, text):
    assert visible_text(page) == text


# ---- tables beyond a broadcast, and columns of any name --------------------------------------------------------


@pytest.mark.parametrize("rows_", [0, 1_000_000])
def test_decontaminate_by_shuffle(spark, monkeypatch, rows_):
    monkeypatch.setattr(decontaminate_module, "BROADCAST_ROWS", rows_)
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(20)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate((20, 13, 1, 5, 3, 30, 2, 13))] + [(9, None)]
    rows = [(i, " ".join(rng.choice([*vocabulary, items[k][1]]) for k in rng.choices(range(8), k=rng.randrange(0, 25)))) for i in range(50)]
    rows += [(60, None), (61, ""), (3, rows[3][1]), (None, items[1][1]), (None, "nothing of it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got} == contamination_plain(rows, items)


def test_stages_take_columns_of_any_name_and_type(spark):
    names = "doc_id long, text string, quarry_key int, kept_doc_id int, bad_id int, bad_copy int, k0 int, whole map<string,int>, `a.b` int, n int"
    text = "a text of several words that says nothing at all"
    docs = spark.createDataFrame([(i, f"{text} {i // 2}", 1, 2, 3, 4, 5, {"x": 6}, 7, 8) for i in range(4)] + [(3, f"{text} 1", 1, 2, 3, 4, 5, {"x": 6}, 7, 8)], names)
    items = spark.createDataFrame([(1, "other words")], "item_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    stages = {"equal": (keep_one_of_equal(docs), [1, 3]), "near": (keep_one_of_near(docs.where("doc_id < 2")), [0]), "clean": (without_contaminated(docs, items), [0, 1, 2, 3, 3]), "good": (without_rejected(docs, none, threshold=0.2), [0, 1, 2, 3, 3])}
    for name, (out, ids) in stages.items():
        rows = out.collect()
        assert out.columns == docs.columns and sorted(r.doc_id for r in rows) == ids, name
        assert all(tuple(r)[2:] == (1, 2, 3, 4, 5, {"x": 6}, 7, 8) for r in rows), name
