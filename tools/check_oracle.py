"""Run registered queries in Spark and their oracle SQL in DuckDB; compare rows, schema and values.

Usage: python tools/check_oracle.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from staylens.plans.registry import load_all  # noqa: E402
from staylens.session import local_session  # noqa: E402
from staylens.sources.roles import TABLES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 4)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in args if not a.startswith("/")]
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name, q in load_all().items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sdf = q.fn(spark, sf)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(exc).__name__}: {str(exc)[:400]}")
            bad += 1
            continue
        dt = time.time() - t0
        if not q.sql:
            print(f"ROWS {name}: {len(srows)} rows ({dt:.1f}s, no oracle)")
            continue
        try:
            res = con.execute(q.sql)
            dcols = [c[0] for c in res.description]
            drows = res.fetchall()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(exc)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {name}: columns {sorted(scols)} vs {sorted(dcols)}")
            bad += 1
            continue
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        if a != b:
            bad += 1
            print(f"FAIL {name}: {len(a)} vs {len(b)} rows")
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            for x, y in diff:
                print("   spark:", str(x)[:300])
                print("   duck :", str(y)[:300])
        else:
            print(f"OK   {name}: {len(a)} rows ({dt:.1f}s)")
    print(f"{bad} failures")
    spark.stop()


if __name__ == "__main__":
    main()
