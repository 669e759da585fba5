"""Spark rows and DuckDB rows in one comparable form."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, int):
        return float(f"{v:.15g}")
    if hasattr(v, "isoformat"):
        return str(v)[:19].removesuffix(" 00:00:00")
    try:
        return float(f"{float(v):.9g}") if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(norm(x) for x in r)) for r in df.select(*cols).collect())


def sql_rows(con, sql):
    rel = con.sql(sql)
    at = sorted(range(len(rel.columns)), key=rel.columns.__getitem__)
    return [rel.columns[i] for i in at], sorted(repr(tuple(norm(r[i]) for i in at)) for r in rel.fetchall())
