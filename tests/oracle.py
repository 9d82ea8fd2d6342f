"""Runs a registered query and its SQL on one of the given folders and compares the rows."""

from __future__ import annotations

import decimal

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v) if not isinstance(v, decimal.Decimal) or v.as_tuple().exponent == 0 else f"DEC{v}"


def compare(spark, query, sql: str, sf: str = SF) -> int:
    df = query(spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    res = db.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in res.fetchall())
    assert got == want
    return len(got)
