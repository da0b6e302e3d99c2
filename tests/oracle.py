"""A registered query against its DuckDB SQL."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(names, records):
    return sorted(tuple(_text(x) for x in r) for r in records)


def sql_rows(sf_dir, text):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], rows(names, [[r[i] for i in order] for r in cur.fetchall()])


def check(spark, sf_dir, query, text):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = rows(names, df.select(*[f"`{n}`" for n in names]).collect())
    want_names, want = sql_rows(sf_dir, text)
    assert names == want_names
    assert got == want
