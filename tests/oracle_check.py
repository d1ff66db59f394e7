"""Local stand-in for the driver's correctness gate.

Runs queries()[name] with Spark and oracle_sql()[name] with DuckDB on the
same parquet tables and compares row count, column names and the sorted
rows (doubles compared after rounding).

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import __spark_entry__ as E  # noqa: E402
from shopgroups.session import build_session  # noqa: E402
from shopgroups.sources.tables import TABLE_NAMES, table_path  # noqa: E402


STRICT = os.environ.get("ORACLE_STRICT") == "1"  # compare floats bit for bit


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return v if STRICT else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def key(row):
    return tuple((x is None, str(type(x).__name__) if x is not None else "", str(x)) for x in row)


def compare(spark, con, sf_dir, name, sql):
    t0 = time.time()
    sdf = E.queries()[name](spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    ok_cols = sorted(scols) == sorted(dcols)
    if not ok_cols:
        return False, f"columns differ: spark={scols} duck={dcols}", t1 - t0
    order = [dcols.index(c) for c in scols]
    drows = [tuple(r[i] for i in order) for r in drows]
    sn = sorted((tuple(norm(x) for x in r) for r in srows), key=key)
    dn = sorted((tuple(norm(x) for x in r) for r in drows), key=key)
    if len(sn) != len(dn):
        return False, f"rows differ: spark={len(sn)} duck={len(dn)}", t1 - t0
    for a, b in zip(sn, dn):
        if a != b:
            return False, f"first diff: spark={a} duck={b}", t1 - t0
    return True, f"{len(sn)} rows", t1 - t0


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or sorted(E.oracle_sql())
    spark = build_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    sqls = E.oracle_sql()
    bad = 0
    for name in names:
        if name not in sqls:
            print(f"SKIP {name}: no oracle")
            continue
        try:
            ok, msg, secs = compare(spark, con, sf_dir, name, sqls[name])
        except Exception as exc:  # noqa: BLE001
            ok, msg, secs = False, f"error: {str(exc)[:400]}", 0.0
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {name}: {msg} ({secs:.1f}s)", flush=True)
    print(f"{len(names) - bad}/{len(names)} passed")
    spark.stop()


if __name__ == "__main__":
    main()
