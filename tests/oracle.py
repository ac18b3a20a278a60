"""Runs a query's SQL in DuckDB and compares it with Spark's rows, in any order."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v) -> str:
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    if hasattr(v, "quantize"):
        return repr(round(float(v), 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(df, con, sql: str) -> None:
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    want = rows_of([c[0] for c in found.description], found.fetchall())
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1], ([x for x in got[1] if x not in set(want[1])][:3], [x for x in want[1] if x not in set(got[1])][:3])
