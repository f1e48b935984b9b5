"""Run registered queries in Spark and their DuckDB statements, compare results.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
Comparison: same column names, same row count, same multiset of rows after
normalising values to text (order-insensitive).
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return f"{v:.9g}"
    if isinstance(v, dt.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(v, dt.date):
        return v.strftime("%Y-%m-%d")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return str(v)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = sorted(tuple(_norm(r[i]) for i in order) for r in rows)
    return cols, out


def digest(rows):
    h = hashlib.sha256()
    for r in rows:
        h.update("\x1f".join(r).encode())
        h.update(b"\x1e")
    return h.hexdigest()[:16]


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK_ERROR", repr(e)[:300])
            if verbose:
                print(f"{name:40s} SPARK_ERROR {repr(e)[:300]}", flush=True)
            continue
        t1 = time.time()
        if name not in sqls:
            results[name] = ("ROWS_ONLY", len(s_rows))
            if verbose:
                print(f"{name:40s} rows-only rows={len(s_rows)} spark={t1 - t0:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(sqls[name])
            d_cols = [c[0] for c in cur.description]
            d_rows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = ("DUCK_ERROR", repr(e)[:300])
            if verbose:
                print(f"{name:40s} DUCK_ERROR {repr(e)[:300]}", flush=True)
            continue
        sc, sr = canon(s_cols, s_rows)
        dc, dr = canon(d_cols, d_rows)
        ok = sc == dc and len(sr) == len(dr) and digest(sr) == digest(dr)
        status = "OK" if ok else "MISMATCH"
        detail = ""
        if not ok:
            if sc != dc:
                detail = f"cols spark={sc} duck={dc}"
            elif len(sr) != len(dr):
                detail = f"rows spark={len(sr)} duck={len(dr)}"
            else:
                diff = [(a, b) for a, b in zip(sr, dr) if a != b][:2]
                detail = f"first diffs {diff}"
        results[name] = (status, detail)
        if verbose:
            print(f"{name:40s} {status} rows={len(sr)} spark={t1 - t0:.1f}s {detail}", flush=True)
    return results


if __name__ == "__main__":
    from chalkline.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK", "ROWS_ONLY")}
    print(f"{len(res) - len(bad)}/{len(res)} ok")
    for k, v in bad.items():
        print("FAIL", k, v)
