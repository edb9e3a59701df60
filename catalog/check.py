"""Compare registered queries with their SQL: ``python -m catalog.check <sf_dir> [names...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from catalog.oracles import oracle_sql
from catalog.queries import QUERIES
from inkwitness.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'").fetchall()
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "∅" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark, con, sf: str, name: str) -> str:
    t = time.time()
    got = QUERIES[name](spark, sf).toPandas()
    spark_s = time.time() - t
    sql = oracle_sql().get(name)
    if sql is None:
        return f"{name:36s} rows {len(got):8d} spark {spark_s:6.2f}  (no SQL)"
    t = time.time()
    want = con.execute(sql).df()
    duck_s = time.time() - t
    if sorted(got.columns) != sorted(want.columns):
        return f"{name:36s} COLUMNS {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if len(a) != len(b) or not a.equals(b):
        extra = a.merge(b, how="outer", indicator=True)
        odd = extra[extra["_merge"] != "both"].head(4)
        return f"{name:36s} DIFFER {len(a)} vs {len(b)}\n" + odd.to_string(max_colwidth=160)
    return f"{name:36s} ok {len(a):8d} spark {spark_s:6.2f} duckdb {duck_s:6.2f}"


if __name__ == "__main__":
    folder, chosen = sys.argv[1], sys.argv[2:] or list(QUERIES)
    session, connection = local_session("8", "12g", "8"), connect(folder)
    for query_name in chosen:
        try:
            print(compare(session, connection, folder, query_name), flush=True)
        except Exception as error:  # keep going: the point is the list
            print(f"{query_name:36s} FAIL {str(error)[:700]}", flush=True)
