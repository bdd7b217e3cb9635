"""Rows of a Spark query against rows of DuckDB SQL over the same Parquet files."""

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return bytes(v) if isinstance(v, bytearray) else v


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rows = con.execute(sql).fetchall()
    names = [d[0] for d in con.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def assert_same(df, sql, sf_dir):
    (names, got), (want_names, want) = spark_rows(df), oracle_rows(sql, sf_dir)
    assert names == want_names
    assert got == want, f"only here: {list((got - want).items())[:3]}; missing: {list((want - got).items())[:3]}"
