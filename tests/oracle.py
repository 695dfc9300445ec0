"""Compares a query with its SQL on the same tables."""

import glob
import math
import os

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def duck(sf_dir=SF):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}") + 0.0
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))


def compare(spark, con, query, sql, sf_dir=SF):
    df = query(spark, sf_dir)
    names, got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want_names, want = rows_of(columns, cur.fetchall())
    assert names == want_names, (names, want_names)
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want, strict=True):
        assert g == w, f"\n{names}\n{g}\n{w}"
    return len(got)
