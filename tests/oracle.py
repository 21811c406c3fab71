"""Compare catalog queries with their SQL twins on DuckDB.

    python tests/oracle.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for col in df.columns:
        if str(df[col].dtype).startswith("datetime64"):
            df[col] = df[col].dt.tz_localize(None).astype("datetime64[us]")
        elif df[col].dtype == object:
            df[col] = df[col].map(lambda v: v if v is None or isinstance(v, str) else str(v)).where(df[col].notna(), None)
        if df[col].dtype == bool:
            df[col] = df[col].map(str)
        elif str(df[col].dtype) in ("Int64", "Int32", "Int16", "Int8"):
            df[col] = df[col].astype(float)
        elif str(df[col].dtype) == "boolean":
            df[col] = df[col].map(lambda v: None if pd.isna(v) else str(bool(v)))
    return df.sort_values(list(df.columns), na_position="first", key=lambda s: s.astype(str) if s.dtype == object else s).reset_index(drop=True)


def compare(a: pd.DataFrame, b: pd.DataFrame) -> str | None:
    """None when equal, otherwise what differs."""
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} vs {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    types = [f"{c}:{a[c].dtype}/{b[c].dtype}" for c in a.columns if str(a[c].dtype)[:3] != str(b[c].dtype)[:3]]
    a, b = normal(a), normal(b)
    for col in a.columns:
        x, y = a[col], b[col]
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = same.idxmin()
            return f"{col}: {(~same).sum()} of {len(a)} differ, first {x[i]!r} vs {y[i]!r}; row {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    return f"TYPES {types}" if types else None


def main(argv: list[str]) -> int:
    from tickloom.session import build_session

    import __spark_entry__ as e

    sf = "/root/testdata/sf0.01"
    if argv and argv[0] == "--sf":
        sf, argv = argv[1], argv[2:]
    q, sql = e.queries(), e.oracle_sql()
    names = [n for n in q if not argv or any(n.startswith(p) for p in argv)]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            got = q[n](spark, sf).toPandas()
            dt = time.time() - t0
            if n in sql:
                res = compare(got, con.execute(sql[n]).df())
                note = "ok" if res is None else ("ok " + res if res.startswith("TYPES") else "DIFF " + res)
            else:
                note = "rows-only"
            empty = " EMPTY" if len(got) == 0 else ""
            nulls = [c for c in got.columns if len(got) and got[c].isna().all()]
            print(f"{n:42s} {dt:6.2f}s {len(got):7d} {note[:900]}{empty}{' ALLNULL ' + str(nulls) if nulls else ''}", flush=True)
            bad += note.startswith("DIFF")
        except Exception as ex:  # noqa: BLE001
            bad += 1
            print(f"{n:42s} ERROR {type(ex).__name__}: {str(ex)[:1200]}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
