"""Compares a query's rows with its SQL in DuckDB, floats to nine digits."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    return v


def rows(columns, found):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(repr([norm(r[i]) for i in at]) for r in found)


def same(spark, sf, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df, want = query(spark, sf), con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
