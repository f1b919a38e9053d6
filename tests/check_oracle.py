"""Compare registered queries with their check SQL: ``python tests/check_oracle.py [sf] [name-part ...]``."""

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from courtflow.session import build_session  # noqa: E402


def norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        v = []
        for i in order:
            x = r[i]
            if isinstance(x, float):
                x = round(x, 6) + 0.0
            elif x is not None and not isinstance(x, (bool, int, str)):
                x = str(x)
            v.append(x)
        out.append(tuple(v))
    return sorted(out, key=lambda t: tuple((a is None, str(a)) for a in t)), [cols[i] for i in order]


def compare(spark, con, name, sf):
    t = time.time()
    df = entry.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t
    a, ca = norm(rows, df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "rows-only", len(rows), took, ""
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    b, cb = norm(rel.fetchall(), cols)
    if ca != cb:
        return "SCHEMA", len(rows), took, f"{ca} vs {cb}"
    if len(a) != len(b):
        return "COUNT", len(a), took, f"{len(a)} vs {len(b)}; {a[:2]} vs {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return "VALUES", len(a), took, f"{len(bad)} differ: {ca}\n   {bad[0][0]}\n   {bad[0][1]}"
    return "ok", len(a), took, ""


def connect(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


if __name__ == "__main__":
    sf = f"/root/testdata/sf{sys.argv[1]}" if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    for name in entry.queries():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            status, n, took, note = compare(spark, con, name, sf)
        except Exception as e:  # noqa: BLE001
            status, n, took, note = "ERROR", 0, 0, str(e)[:900]
        failed += status not in ("ok", "rows-only")
        flag = "" if n else "  <-- EMPTY"
        print(f"{status:10s} {name:40s} rows={n:<7d} {took:5.1f}s {note}{flag}", flush=True)
    print("failed:", failed)
