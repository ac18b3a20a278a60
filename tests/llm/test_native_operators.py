"""Exact dedup, line dedup, decontamination and components against plain versions, with hostile rows."""

import hashlib
import random
import re

import pytest

from quarry.llm import exact_dedup as exact_module
from quarry.llm.components import connected_components
from quarry.llm.decontaminate import decontaminate, without_contaminated
from quarry.llm.exact_dedup import exact_dedup, keep_one_of_equal
from quarry.llm.line_dedup import line_dedup
from quarry.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
EXTRA = "text string, body string, name long, hash string, words string, lines string, rows int, start int, item_id int"


def table(spark, rows):
    """doc_id and text among columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "x", "x", "x", 2, 3, 4) for i, t in rows], "doc_id long, " + EXTRA).repartition(3)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_against_duckdb(spark, name):
    same(QUERIES[name](spark, SF), connect(SF), ORACLE_SQL[name])


def test_exact_dedup(spark, monkeypatch):
    rng = random.Random(3)
    long = "".join(rng.choice("abé\n") for _ in range(20000))
    texts = [None, "", "a", "A", "a ", long, long + "x", "y" + long, long[:8192], long[:4096], "é" * 3000, long]
    rows = [(i, rng.choice(texts)) for i in range(150)] + [(500, "a"), (500, "a"), (None, "a"), (None, "only null id")]
    for block in (16, 4096):
        got = exact_dedup(table(spark, rows), block_bytes=block).collect()
        groups = {}
        for i, t in set(rows):
            groups.setdefault(t or "", set()).add((i, t or ""))
        want = set()
        for t, members in groups.items():
            keep = max((i for i, _ in members if i is not None), default=None)
            want |= {(i, keep, len(members), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i, _ in members}
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_hot_blocks_get_the_same_names(spark):
    rows = [(i, "hot" if i % 3 else f"text {i % 7}") for i in range(900)]
    assert {(r.keep_id, r.group_size) for r in exact_dedup(table(spark, rows)).where("text_sha256 = sha2('hot', 256)").collect()} == {(899, 600)}


def test_exact_dedup_keeps_columns(spark):
    docs = table(spark, [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (2, "b"), (None, "a"), (None, "c"), (None, "d"), (None, "d")])
    out = keep_one_of_equal(docs)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == [("2", "a"), ("2", "b"), ("4", ""), ("None", "c"), ("None", "d")]


def lines_plain(rows, least=10, documents=2):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(strip))
    rank = lambda i: (1 << 63) - 1 if i is None else i
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held.setdefault(key(line), set()).add(rank(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < documents or min(held[key(x)]) == rank(i)]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("documents", [2, 3])
def test_line_dedup(spark, documents):
    rng = random.Random(5)
    pool = ["shared boilerplate line", " SHARED boilerplate LINE\t", "short", "", "  ", "ÉCOLE de la ville", "école de la ville", "another common line", "x" * 9, "x" * 10]
    rows = [(i, "\n".join(rng.choice([*pool, f"own line number {i}"]) for _ in range(rng.randrange(1, 9)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n"), (7, rows[7][1]), (None, "shared boilerplate line\nlast"), (103, "own repeated line\nown repeated line\r")]
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup(table(spark, rows), min_documents=documents).collect())
    assert got == lines_plain(rows, documents=documents)


def contamination_plain(rows, items, n=13):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda t: re.findall(word, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - n + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = set()
    for i, t in set(rows):
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        out.add((i, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontaminate(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)] + ["École", "ÉCOLE", "It", "is"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate((20, 13, 14, 5, 3, 30, 13))]
    items += [(50, None), (51, "..."), (52, items[0][1].upper()), (53, items[3][1])]
    rows = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.6:
            w[rng.randrange(len(w) + 1) : 0] = rng.choice(items[:7])[1].split()
        rows.append((i, rng.choice([" ", ", ", "\n- "]).join(w)))
    rows += [(70, None), (71, ""), (72, "?!"), (3, rows[3][1]), (None, items[1][1]), (73, items[3][1] + "\0" + items[3][1])]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, width int")
    got = decontaminate(table(spark, rows), benchmark).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got} == contamination_plain(rows, items)
    clean = without_contaminated(table(spark, rows), benchmark)
    bad = {(x[0]) for x in contamination_plain(rows, items) if x[4]}
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - bad
    assert clean.columns == table(spark, rows).columns


def test_spans_cover_hits(spark):
    benchmark = spark.createDataFrame([(1, "a b c"), (2, "c d")], "item_id long, text string")
    row = decontaminate(table(spark, [(1, "x a b c d y c d")]), benchmark).first()
    assert [tuple(s) for s in row.spans] == [(1, 4), (4, 5), (6, 8)] and row.n_hit == 6


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, root(x)) for e in edges if e[0] != e[1] for x in e}


def test_empty_tables(spark):
    none = table(spark, [(1, "x")]).where("false")
    assert exact_dedup(none).count() == 0 and line_dedup(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(none, items).count() == 0
    assert [r.n_hit for r in decontaminate(table(spark, [(1, "x y")]), items).collect()] == [0]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
