import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm.fill_in_middle import boundaries, code_points, fill_in_middle, restored

TEXTS = [None, "", "a", "ab", "é中文𝒳 x\ny", "has <S> inside", "<P", "S><", "two\n\nlines\n", "word " * 2000, "<<M", "M>P>S>", "́́"]


def plain(doc_id, text, units):
    """The contract, with Python's strings."""
    text = text or ""
    cuts = [""] + [m[0] for m in re.finditer(units, text, re.S)]
    places = [0]
    for c in cuts[1:]:
        places.append(places[-1] + len(c))
    n = len(places) - 1
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    x, y = places[min(h1 % (n + 1), h2 % (n + 1))], places[max(h1 % (n + 1), h2 % (n + 1))]
    if h4 % 100 < 20:
        return n, "spm", x, y - x, f"<S>{text[y:]}<P>{text[:x]}<M>{text[x:y]}"
    return n, "psm", x, y - x, f"<P>{text[:x]}<S>{text[y:]}<M>{text[x:y]}"


@pytest.mark.parametrize("unit, pattern", [("code points", "."), ("lines", "[^\n]*\n|[^\n]+"), ("runs", "[ \t-\r]+|[0-9]+|[A-Za-z\u0080-\U0010ffff]+|[^ \t-\r0-9A-Za-z\u0080-\U0010ffff]+")])
def test_against_plain_version(spark, unit, pattern):
    rows = [(i, TEXTS[i % len(TEXTS)], "clash", i) for i in range(260)] + [(None, "no id", "x", 0), (5, "a", "y", 1), (5, "a", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n long")
    out = fill_in_middle(docs, unit=unit)
    got = out.withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((d, t or "", *plain(d, t, pattern)) for d, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, r.again, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_units():
    assert boundaries(code_points("ab 12é".encode()), "runs").tolist() == [0, 2, 3, 5, 6]
    assert boundaries(code_points(b"a\n\nb"), "lines").tolist() == [0, 2, 3, 4]
    assert boundaries(code_points("𝒳é".encode()), "code points").tolist() == [0, 1, 2]
    assert boundaries(code_points(b""), "runs").tolist() == [0]


def test_bytes_that_are_no_utf8(spark):
    docs = spark.range(30).selectExpr("id as doc_id", "cast(unhex('61FF62C3') as string) as text")
    assert {r.n for r in fill_in_middle(docs).collect()} == {4}


def test_nothing(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
