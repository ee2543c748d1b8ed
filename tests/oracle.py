"""Rows of a query and of its SQL, compared as multisets."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    out = duckdb.connect()
    out.execute("set TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            out.execute(f"create view {t} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return out


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(v[i]) if v[i] is not None else None for i in order) for v in values) if columns else []


def check(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    con = connect(sf_dir)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, res.fetchall())
    key = lambda r: tuple(x or "" for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
