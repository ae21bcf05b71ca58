"""Compares Spark rows with DuckDB rows over the same folder."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 2")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return str(x) if not isinstance(x, (int, str, bool, type(None))) else x


def same(spark_df, con, sql: str) -> None:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(spark_df.columns), (sorted(names), sorted(spark_df.columns))
    order = sorted(names)
    want = sorted((tuple(value(dict(zip(names, r))[c]) for c in order) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(value(r[c]) for c in order) for r in spark_df.collect()), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    assert got == want, next((g, w) for g, w in zip(got, want) if g != w)
