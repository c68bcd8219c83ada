"""Side-by-side check of ``queries()`` against ``oracle_sql()`` on DuckDB.

    python tests/oracle_compare.py [sf_dir] [key ...]

Prints one line per key: row counts, column match and value match (exact,
after sorting rows).  Mirrors the driver's correctness gate.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from toxiscope.session import local_session  # noqa: E402
from toxiscope.sources.tables import TABLES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v
    if hasattr(v, "tolist"):
        return tuple(norm(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def sort_key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, sqls = entry.queries(), entry.oracle_sql()
    keys = keys or list(qs)
    bad = 0
    for k in keys:
        t0 = time.time()
        try:
            sdf = qs[k](spark, sf)
            scols = sdf.columns
            srows = [tuple(norm(x) for x in r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{k:32s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in sqls:
            print(f"{k:32s} rows={len(srows)} (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(sqls[k])
            dcols = [d[0] for d in cur.description]
            drows = [tuple(norm(x) for x in r) for r in cur.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"{k:32s} DUCKDB ERROR {str(e)[:300]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"{k:32s} COLUMNS spark={scols} duck={dcols}")
            bad += 1
            continue
        stype = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
        dtype = dict(zip(dcols, [str(t) for t in con.sql(sqls[k]).types]))
        twin = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN", "float": "FLOAT"}
        drift = [(c, stype[c], dtype[c]) for c in scols if twin.get(stype[c]) != dtype[c]]
        if drift:
            print(f"{k:32s} TYPES {drift}")
        order = [dcols.index(c) for c in scols]
        drows = [tuple(r[i] for i in order) for r in drows]
        same = sorted(srows, key=sort_key) == sorted(drows, key=sort_key)
        status = "OK" if same and len(srows) == len(drows) else "MISMATCH"
        if status != "OK":
            bad += 1
        print(f"{k:32s} {status} rows spark={len(srows)} duck={len(drows)} {ts:.1f}s")
        if status != "OK":
            a = sorted(srows, key=sort_key)
            b = sorted(drows, key=sort_key)
            sa, sb = set(a), set(b)
            print("   spark-only:", [r for r in a if r not in sb][:3])
            print("   duck-only: ", [r for r in b if r not in sa][:3])
    print(f"{len(keys) - bad}/{len(keys)} ok")


if __name__ == "__main__":
    main(sys.argv)
