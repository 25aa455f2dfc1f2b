"""Local twin of the driver's correctness gate: Spark query vs DuckDB SQL.

usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as E  # noqa: E402,F401
from pliego.plans.contract_view import TABLES  # noqa: E402
from pliego.session import build_session  # noqa: E402


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def main(argv):
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = build_session("local[8]")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sql = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(exc)[:400]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in sql:
            print(f"rows {name}: {len(rows)} rows (no oracle) {dt:.1f}s")
            continue
        try:
            res = con.execute(sql[name])
            ocols = [d[0] for d in res.description]
            orows = res.fetchall()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(exc)[:400]}")
            bad += 1
            continue
        if sorted(cols) != sorted(ocols):
            print(f"FAIL {name}: columns {sorted(cols)} vs {sorted(ocols)}")
            bad += 1
            continue
        a, b = canon(cols, rows), canon(ocols, orows)
        if a != b:
            bad += 1
            diff = [x for x in a if x not in b][:3]
            diff2 = [x for x in b if x not in a][:3]
            print(f"FAIL {name}: {len(a)} vs {len(b)} rows; spark-only {diff}; oracle-only {diff2}")
        else:
            print(f"ok   {name}: {len(a)} rows {dt:.1f}s")
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
