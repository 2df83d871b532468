"""Run registered Spark plans next to their DuckDB oracle and compare.

    python tools/oracle_check.py [--sf /root/testdata/sf0.01] [name ...]

Comparison: row count, column names (sorted), coarse types, and an
order-insensitive hash of the rows with doubles rounded to 6 places.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from promptspark.plans import oracle_sql, queries  # noqa: E402
from promptspark.session import get_spark  # noqa: E402
from promptspark.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(keyed).encode()).hexdigest()[:16], keyed


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    qs, sqls = queries(), oracle_sql()
    names = args.names or sorted(qs)
    spark = get_spark()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.sf}/{t}.parquet')")
    report = {}
    for name in names:
        t0 = time.time()
        try:
            df = qs[name](spark, args.sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            report[name] = {"status": "spark_error", "error": str(e)[:400]}
            print(name, "SPARK ERROR", str(e)[:400], flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            report[name] = {"status": "rows_only", "rows": len(srows), "sec": round(ts, 2)}
            print(f"{name}: rows-only {len(srows)} rows {ts:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(sqls[name])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            report[name] = {"status": "oracle_error", "error": str(e)[:400]}
            print(name, "ORACLE ERROR", str(e)[:400], flush=True)
            continue
        sh, sk = digest(scols, srows)
        oh, ok = digest(ocols, orows)
        same_cols = sorted(scols) == sorted(ocols)
        status = "match" if (same_cols and sh == oh) else "MISMATCH"
        report[name] = {"status": status, "rows": [len(srows), len(orows)], "sec": round(ts, 2)}
        print(f"{name}: {status} rows spark={len(srows)} oracle={len(orows)} {ts:.1f}s", flush=True)
        if not same_cols:
            print("   cols", sorted(scols), sorted(ocols))
        elif sh != oh:
            a, b = set(sk), set(ok)
            print("   only spark:", sorted(a - b)[:3])
            print("   only oracle:", sorted(b - a)[:3])
    print(json.dumps({k: v["status"] for k, v in report.items()}))


if __name__ == "__main__":
    main()
