"""Run a query and its oracle side by side."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, bytearray):
        return bytes(v)
    return v


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def differences(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if names, types and values agree."""
    con = connect(sf_dir)
    df = query(spark, sf_dir)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want_names, want = rows_of(rel.columns, rel.fetchall())
    if got_names != want_names:
        return f"columns {got_names} and {want_names}"
    theirs = dict(zip(rel.columns, map(str, rel.types), strict=True))
    wrong = [(c, k, theirs[c]) for c, k in df.dtypes if k in KIND and KIND[k] != theirs[c]]
    if wrong:
        return f"types {wrong}"
    if got != want:
        off = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:3]
        return f"{len(got)} and {len(want)} rows; {off}"
    return ""
