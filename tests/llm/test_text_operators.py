"""HTML extraction, URL filters, quotation linking and the two classifiers."""

import datetime as dt

import pytest

from quarry.llm.html_text import extract_text, visible_text
from quarry.llm.quality import fit_pu, quality_scores, without_rejected
from quarry.llm.quotations import chat_records, link_quotes
from quarry.llm.toxicity import RunTable, evidence_by_broadcast, evidence_by_join, letter_runs, toxicity_scores
from quarry.llm.url_filter import judge_captures, match_keys

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a  b <b>c</b>\nd<p>e<br>f", "a b c d\n\ne\nf"),
        ("<ul><li>one<li>two<ol start=3><li>x<li>y</ol><li>z</ul>", "- one\n- two\n  3. x\n  4. y\n- z"),
        ("<table><tr><th>A<th>Long<tr><td>1<td>2<td>3</table>after", "A | Long |\n1 | 2    | 3\n\nafter"),
        ("<div hidden>n</div><p style='display : none'>n<p>y<span style='visibility:hidden'>n</span></p><input type=hidden value=n><template>n</template>", "y"),
        ("<head><title>n</title><style>n</style></head><script>if (a < b) '</p>'</script>y<!-- n --><noscript>n</noscript>", "y"),
        ("<pre>  k\n    z</pre>", "  k\n    z"),
        ("<b>unclosed <i>mis</b>nested</i> </div> stray", "unclosed misnested stray"),
        ("<div>a</div><div>b</div><h1>T</h1>c", "a\nb\n\nT\n\nc"),
        ("<table><tr><td>in<table><tr><td>n<td>m</table></table>", "in\n\nn | m"),
        ("a < b and <3", "a < b and <3"),
    ],
)
def test_visible_text(page, text):
    assert visible_text(page) == text


def test_deep_pages_do_not_recurse():
    assert visible_text("<div>" * 20000 + "x") == "x"


def test_extract(spark):
    pages = spark.createDataFrame([(1, "<p>x", "u"), (None, None, "u")], "page_id long, html string, text string")
    assert {tuple(r) for r in extract_text(pages).collect()} == {(1, "x"), (None, "")}


def day(n):
    return dt.date(2024, 1, n)


def test_url_intervals(spark):
    entries = spark.createDataFrame(
        [("l", "host:bad.com", "add", day(5)), ("l", "host:bad.com", "remove", day(10)), ("l", "host:bad.com", "remove", day(11)), ("l", "host:bad.com", "add", day(20)), ("m", "path:ok.org/ads", "add", day(1)),
         ("l", "host:same.com", "add", day(3)), ("l", "host:same.com", "remove", day(3)), (None, "host:ok.org", "add", day(1)), ("l", "host:ok.org", "what", day(1))],
        "list string, key string, action string, dated date",
    )
    captures = [
        (1, "http://bad.com/", 4, 0), (2, "https://user@WWW.Bad.com:80/x?y", 5, 1), (3, "http://bad.com", 9, 1), (4, "http://bad.com", 10, 0), (5, "http://notbad.com", 6, 0), (6, "http://bad.com#f", 25, 1),
        (7, "http://ok.org/ads/1?q", 2, 1), (8, "http://ok.org/adsx", 2, 0), (9, "http://same.com", 4, 0), (10, None, 5, 0), (11, "no url", 5, 0), (12, "http://bad.com", None, 0), (2, "http://bad.com", 6, 1),
    ]
    rows = spark.createDataFrame([(i, u, None if n is None else day(n), "x") for i, u, n, _ in captures], "capture_id long, url string, fetched date, key string")
    got = sorted((r.capture_id, r.blocked) for r in judge_captures(rows, entries).collect())
    assert got == sorted((i, bool(b)) for i, _, _, b in captures)
    assert judge_captures(rows, entries.where("false")).where("blocked").count() == 0


def test_hosts_with_a_last_dot_or_brackets(spark):
    entries = spark.createDataFrame([("l", "host:bad.com", "add"), ("l", "path:bad.org/ads", "add"), ("l", "host:[::1]", "add"), ("l", "host:com", "add")], "list string, key string, action string").selectExpr("*", "date '2024-01-01' as dated")
    urls = {
        "http://bad.com./x": (2, "bad.com"), "http://www.Bad.Com.:80": (2, "www.bad.com"), "http://bad.org./ads/1": (1, "bad.org"), "http://[::1]:80/x": (1, "[::1]"), "http://[::2]/": (0, "[::2]"),
        "http://[::1/x": (0, None), "http://a]b/x": (0, None), "http://./x": (0, None), "http://[::ffff:1.2.3.com]": (0, "[::ffff:1.2.3.com]"), "http://a.com:x/": (0, None),
    }
    captures = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "capture_id long, url string").selectExpr("*", "date '2024-02-01' as fetched")
    got = {r.capture_id: (r.n_matches, r.host) for r in judge_captures(captures, entries).collect()}
    assert {u: got[i] for i, u in enumerate(urls)} == urls


def test_match_keys(spark):
    row = spark.createDataFrame([("http://a.b.c/x/y/?q",)], "url string").selectExpr(match_keys("url") + " as k").first()
    assert row.k == ["host:a.b.c", "host:b.c", "host:c", "path:a.b.c/x", "path:a.b.c/x/y"]


def test_quotations(spark):
    first, second = "The first message is here.\nIt has two lines.", "Another opinion about that."
    rows = [
        (1, 0, "user", first),
        (1, 1, "user", second),
        (1, 2, "assistant", "On Monday Ann wrote:\n> The  first message IS here.\n> It has two lines.\n\nI agree with it."),
        (1, 3, "user", "> On Tuesday Bob wrote:\n>> The first message is here.\n> I agree with it.\nMe too, of course."),
        (1, 4, "user", "> unknown origin of this\nStill here."),
        (1, 4, "user", "> unknown origin of this\nStill here."),
        (2, 5, "user", "> The first message is here.\nOther conversation."),
        (3, 0, "user", None),
        (None, 1, "user", "lost"),
    ]
    got = {(r.conv_id, r.turn): r for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 8
    assert [got[1, t].parent_turn for t in range(5)] == [None, None, 0, 2, None]
    assert [got[1, t].thread_turn for t in range(5)] == [0, 1, 0, 0, 4]
    assert got[1, 3].depth == 2 and got[1, 2].body == "I agree with it." and got[1, 3].body == "Me too, of course."
    assert got[2, 5].parent_turn is None and got[2, 5].n_quotes == 1 and got[2, 5].n_linked == 0
    assert got[3, 0].body == ""
    threads = {(r.conv_id, r.thread_turn): [m.turn for m in r.messages] for r in chat_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert threads[1, 0] == [0, 2, 3]


def accuracy(spark, rows, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    found = rows.join(labels, "doc_id").where("held_out").collect()
    return sum(r.predicted == r[label] for r in found) / len(found), [r for r in found if r.predicted != r[label]]


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    right, _ = accuracy(spark, quality_scores(docs, labels), "quality")
    assert right > 0.95


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    right, wrong = accuracy(spark, toxicity_scores(docs, labels), "toxic")
    assert right > 0.9
    assert all(r.toxic == 1 for r in wrong)  # some toxic rows say nothing toxic; clean rows are left alone


def test_run_table_finds_all_runs_and_no_others():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        keys = np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64))
        ratio = rng.normal(size=len(keys)).astype(np.float32)
        table = RunTable(keys, ratio)
        assert (table.get(keys) == ratio).all()
        assert not table.get(np.setdiff1d(rng.integers(0, 1 << 48, 1000, dtype=np.uint64), keys)).any()


def test_evidence_is_the_same_by_broadcast_and_by_join(spark):
    import numpy as np

    texts = ["You bloody FOOL, fool!", None, "", "...", "a", "fool fool fool fool nice", "über Übel\nüber 12 aaaaaaaaaaaaaaa", "one two", "You bloody FOOL, fool!"] + ["fool " * 3000]
    docs = spark.createDataFrame([(i % 7, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, row int, word string").repartition(3)
    runs = np.unique(letter_runs(texts)[0])
    ratio = np.random.default_rng(2).normal(0, 3, len(runs)).astype(np.float32)
    runs, ratio = runs[::2], ratio[::2]
    contexts = np.unique(runs[::3] >> np.uint64(8) << np.uint64(8))  # runs that were not seen go by their contexts
    runs, ratio = np.concatenate((runs, contexts)), np.concatenate((ratio, np.linspace(-2, 2, len(contexts), dtype=np.float32)))
    table = spark.createDataFrame(list(zip(runs.astype(np.int64).tolist(), ratio.tolist(), strict=True)), "key long, ratio float")
    shared = spark.sparkContext.broadcast(RunTable(runs, ratio))
    ways = [sorted(tuple(r) for r in way.collect()) for way in (evidence_by_broadcast(docs, "text", shared), evidence_by_join(docs, "text", table))]
    assert len(ways[0]) == len(ways[1]) == len(texts)
    assert np.allclose(ways[0], ways[1], atol=1e-4)


def test_toxicity_is_the_same_beyond_the_broadcast(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    near, far = (sorted((r.doc_id, r.score) for r in toxicity_scores(docs, labels, broadcast_runs=n).collect()) for n in (10**9, 0))
    assert [a for a, _ in near] == [a for a, _ in far] and max(abs(a[1] - b[1]) for a, b in zip(near, far, strict=True)) < 1e-3


def test_rejection_judges_each_row_by_its_own_text(spark):
    docs = spark.createDataFrame([(None, ""), (None, "words of a text"), (1, ""), (1, "more words of a text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted(r.text for r in without_rejected(docs, none, threshold=0.2).collect()) == ["more words of a text", "words of a text"]


def test_classifiers_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, " \n", 1.0), (4, "word " * 5, 1.0), (None, "x", 1.0), (4, "word " * 5, 1.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nulls = spark.createDataFrame([(4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, nulls):
        assert sorted(r.score for r in quality_scores(docs, labels).collect()) == [0.0, 0.0, 0.0, 0.5, 0.5, 0.5]
        assert {r.predicted for r in toxicity_scores(docs, labels).collect()} == {0}
        assert quality_scores(docs.where("false"), labels).count() == 0 and toxicity_scores(docs.where("false"), labels).count() == 0
    assert without_rejected(docs, none, threshold=0.2).columns == docs.columns


def test_pu_learning_finds_the_negatives():
    import numpy as np

    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (2000, 3)), rng.normal(-2, 1, (400, 3))
    w = fit_pu(good[:1000], np.vstack((good[1000:], bad)), 1000 / 1400)
    score = lambda x: x @ w[:-1] + w[-1]
    assert (score(good) > 0).mean() > 0.95 and (score(bad) < 0).mean() > 0.9
