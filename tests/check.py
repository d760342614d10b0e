"""Run queries and their SQL side by side and compare whole results."""

from __future__ import annotations

import math
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return str(v)


def _table(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
    return [columns[i] for i in order], out


def compare(spark: SparkSession, con, sf_dir: str, fn, sql: str) -> tuple[str, int, float, float]:
    """('' or what differs, rows, seconds in Spark, seconds in SQL)."""
    t = time.time()
    df = fn(spark, sf_dir)
    got = _table(df.columns, df.collect())
    t1 = time.time()
    rel = con.sql(sql)
    want = _table(list(rel.columns), rel.fetchall())
    t2 = time.time()
    problem = ""
    if got[0] != want[0]:
        problem = f"columns {got[0]} against {want[0]}"
    elif len(got[1]) != len(want[1]):
        problem = f"{len(got[1])} rows against {len(want[1])}"
    else:
        for a, b in zip(got[1], want[1]):
            if a != b:
                problem = f"{a} against {b}"
                break
    return problem, len(got[1]), t1 - t, t2 - t1
