"""Side-by-side check of queries() against oracle_sql() (Spark vs DuckDB).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""
from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def frame_rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = []
    for rec in df[cols].itertuples(index=False):
        rows.append(tuple(_norm(None if (not isinstance(x, (list, tuple, dict, bytes)) and pd.isna(x)) else x)
                          for x in rec))
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, name: str, sf_dir: str, con=None) -> tuple[bool, str]:
    import __spark_entry__ as E
    qs, orc = E.queries(), E.oracle_sql()
    t0 = time.time()
    sdf = qs[name](spark, sf_dir).toPandas()
    t1 = time.time()
    if name not in orc:
        return True, f"rows-only {len(sdf)} rows ({t1 - t0:.2f}s)"
    con = con or duck(sf_dir)
    odf = con.execute(orc[name]).df()
    if sorted(c.lower() for c in sdf.columns) != sorted(c.lower() for c in odf.columns):
        return False, f"columns differ: spark={list(sdf.columns)} oracle={list(odf.columns)}"
    sdf.columns = [c.lower() for c in sdf.columns]
    odf.columns = [c.lower() for c in odf.columns]
    if len(sdf) != len(odf):
        return False, f"row count spark={len(sdf)} oracle={len(odf)}"
    a, b = frame_rows(sdf), frame_rows(odf)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. spark={bad[0][0]} oracle={bad[0][1]}"
    return True, f"{len(sdf)} rows equal ({t1 - t0:.2f}s)"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from cohortbeam.session import get_spark
    import __spark_entry__ as E
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    names = names or sorted(E.queries())
    fails = 0
    for n in names:
        try:
            ok, msg = compare(spark, n, sf_dir, con)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        fails += not ok
        print(f"{'OK ' if ok else 'BAD'} {n}: {msg}", flush=True)
    print(f"{len(names) - fails}/{len(names)} ok")
    return 1 if fails else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
