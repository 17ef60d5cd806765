"""Compares a query's rows with its SQL's, run by DuckDB on the same files."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return repr(v)


def same(df, con, sql):
    rows = df.collect()
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    ours = sorted(tuple(plain(r[c]) for c in cols) for r in rows)
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert ours == theirs
    return len(ours)
