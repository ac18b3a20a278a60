"""The entry works with and without the subpackage for training data."""

import subprocess
import sys

import __spark_entry__ as entry


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "doc_id", "score", "rank"]
    assert df.count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_llm():
    code = "import sys; sys.modules['quarry.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') and n[2].isdigit() for n in q); assert 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_customers_are_spread_over_tasks(spark):
    """Parsing is the work, not reading: one split of a small file must not be one task."""
    from quarry.queries import load

    rows = load()[0]["bm25_expand_constraints"](spark, "/root/testdata/sf0.001").rdd.glom().map(len).collect()
    assert sum(rows) == 150 and sum(n > 0 for n in rows) > 32
