"""Compare catalog queries with their SQL on one scale: python check.py [-d DIR] [name or prefix ...]"""

import argparse
import math
import time

import duckdb

from parley.plans import bindings, catalog
from parley.session import build_session


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 2**53 else str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def compare(spark, con, name, sf):
    t = time.time()
    df = catalog.QUERIES[name](spark, sf)
    rows = df.collect()
    took = time.time() - t
    cols = sorted(df.columns)
    ours = sorted("|".join(canon(r[c]) for c in cols) for r in rows)
    if name not in catalog.SQL:
        return f"rows-only {len(rows)}", took
    t = time.time()
    cur = con.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    res = cur.fetchall()
    sql_took = time.time() - t
    if sorted(names) != cols:
        return f"FAIL columns {cols} vs {sorted(names)}", took
    at = [names.index(c) for c in cols]
    theirs = sorted("|".join(canon(r[i]) for i in at) for r in res)
    if ours == theirs:
        return f"ok {len(rows)} (sql {sql_took:.1f}s)" + (" EMPTY" if not rows else ""), took
    a, b = set(ours) - set(theirs), set(theirs) - set(ours)
    return f"FAIL rows {len(ours)} vs {len(theirs)}\n   cols {cols}\n   ours  {sorted(a)[:3]}\n   theirs {sorted(b)[:3]}", took


def connect(sf):
    con = duckdb.connect()
    for n in bindings.NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{sf}/{n}.parquet')")
    return con


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    catalog.load()
    spark = build_session("check", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
                                                 "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(a.d)
    bad = 0
    for name in catalog.QUERIES:
        if a.names and not any(name.startswith(p) for p in a.names):
            continue
        try:
            verdict, took = compare(spark, con, name, a.d)
        except Exception as ex:  # report and go on with the next query
            verdict, took = f"FAIL {type(ex).__name__} {str(ex)[:900]}", 0
        bad += verdict.startswith("FAIL")
        print(f"{name:34s} {took:6.1f}s {verdict}", flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
