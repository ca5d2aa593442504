"""Compare registered queries with their SQL on one data folder.

usage: check_oracle.py SF_DIR [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, int):
        return v
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)
    return v


def compare(df, con, sql):
    """Problems found, rows, seconds for Spark and SQL."""
    t0 = time.time()
    got_cols, got = df.columns, [tuple(norm(v) for v in row) for row in df.collect()]
    t1 = time.time()
    if sql is None:
        return [], len(got), t1 - t0, 0.0
    res = con.execute(sql)
    want_cols, want = [c[0] for c in res.description], [tuple(norm(v) for v in row) for row in res.fetchall()]
    t2 = time.time()
    probs = []
    if sorted(got_cols) != sorted(want_cols):
        probs.append(f"columns {sorted(got_cols)} != {sorted(want_cols)}")
        return probs, len(got), t1 - t0, t2 - t1
    order = sorted(got_cols)
    gi, wi = [got_cols.index(c) for c in order], [want_cols.index(c) for c in order]

    def key(row):
        return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)

    g = sorted((tuple(r[i] for i in gi) for r in got), key=key)
    w = sorted((tuple(r[i] for i in wi) for r in want), key=key)
    if len(g) != len(w):
        probs.append(f"rows {len(g)} != {len(w)}")
    if g != w:
        gs, ws = set(g), set(w)
        a, b = [x for x in g if x not in ws][:2], [x for x in w if x not in gs][:2]
        n = sum(1 for x in g if x not in ws)
        probs.append(f"{n} differ; {order}\n   spark {a}\n   sql   {b}")
    for i, c in enumerate(order):
        tg = {type(r[i]).__name__ for r in g} - {"NoneType"}
        tw = {type(r[i]).__name__ for r in w} - {"NoneType"}
        if g and w and tg != tw:
            probs.append(f"type of {c}: {tg} != {tw}")
    return probs, len(got), t1 - t0, t2 - t1


def main():
    from barloom.plans.catalog import load
    from barloom.session import local_session

    sf, prefixes = sys.argv[1], sys.argv[2:]
    spark = local_session("check", cpus="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, e in load().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            probs, n, ts, td = compare(e.run(spark, sf), con, e.sql)
        except Exception as ex:  # report and go on
            probs, n, ts, td = [f"{type(ex).__name__}: {str(ex)[:700]}"], 0, 0, 0
        bad += bool(probs)
        print(f"{'FAIL' if probs else 'ok  '} {name} rows={n} spark={ts:.1f}s sql={td:.1f}s{'' if e.sql else ' (rows only)'}", flush=True)
        for p in probs:
            print("   ", p, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
