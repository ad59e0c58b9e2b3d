"""Compares a registered query with its SQL on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(folder):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9 * max(1, abs(a))


def check(df, sql, folder):
    cur = connected(folder).execute(sql)
    cols = [x[0] for x in cur.description]
    want = sorted(cur.fetchall(), key=lambda r: [(x is None, str(x)) for x in r])
    assert sorted(df.columns) == sorted(cols)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: [(x is None, str(x)) for x in r])
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(same(x, y) for x, y in zip(g, w)), (g, w)
