"""Runs a registered query and its DuckDB SQL over the same folder and compares names, counts and values."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (float, decimal.Decimal)):
        return "nan" if math.isnan(x) else f"{float(x):.9g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, folder, query, sql):
    df = query(spark, folder)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    theirs = rows_of(names, got.fetchall())
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    assert len(mine) == len(theirs), (len(mine), len(theirs), [r for r in mine if r not in set(theirs)][:2], [r for r in theirs if r not in set(mine)][:2])
    assert mine == theirs, [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b][:3]
    return len(mine)
