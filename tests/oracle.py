"""Spark against DuckDB, as the driver compares them."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.sql(f"create view {t} as select * from read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return c


def shown(x):
    if x is None or x != x:
        return None
    return repr(float(x)) if isinstance(x, float) else str(x)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(([shown(r[c]) for c in cols] for r in df.collect()), key=str)


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted(([shown(r[i]) for i in order] for r in cur.fetchall()), key=str)
