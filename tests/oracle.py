"""Holds a query's rows against DuckDB's."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, list | tuple):
        return repr([plain(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


def rows_of(names, rows):
    order = sorted(names)
    return sorted(tuple(plain(r[n]) for n in order) for r in rows)


def expected(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(sql)
    names = found.columns
    return names, [dict(zip(names, r, strict=True)) for r in found.fetchall()]


def assert_same(df, sql, sf_dir):
    names, rows = expected(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [r.asDict() for r in df.collect()]) == rows_of(names, rows)
