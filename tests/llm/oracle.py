"""Runs a query and its DuckDB twin over one folder and compares them row by row."""

import os

import duckdb

import __spark_entry__ as e

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def frames(spark, name, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{sf}/{t}.parquet') else ''}'")
    df = e.queries()[name](spark, sf)
    rel = con.sql(e.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns), (cols, rel.columns)

    def plain(rows, names):
        at = [list(names).index(c) for c in cols]
        return sorted((tuple(r[i] for i in at) for r in rows), key=repr)

    return plain([tuple(r) for r in df.collect()], df.columns), plain(rel.fetchall(), rel.columns)
