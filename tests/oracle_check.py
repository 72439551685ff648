"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive hash of values.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v) if os.environ.get("ORACLE_EXACT") else repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def spark_rows(spark, fn, sf_dir):
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    return list(df.columns), rows


def check(spark, name, fn, sql, sf_dir, verbose=True):
    t0 = time.time()
    s_cols, s_rows = spark_rows(spark, fn, sf_dir)
    t1 = time.time()
    if sql is None:
        return {"name": name, "rows": len(s_rows), "oracle": None, "ok": None, "spark_s": t1 - t0}
    d_cols, d_rows = duck(sf_dir, sql)
    sh, sl = digest(s_cols, s_rows)
    dh, dl = digest(d_cols, d_rows)
    ok = sorted(s_cols) == sorted(d_cols) and len(s_rows) == len(d_rows) and sh == dh
    res = {"name": name, "rows": len(s_rows), "oracle_rows": len(d_rows), "ok": ok, "spark_s": round(t1 - t0, 2)}
    if not ok and verbose:
        res["cols"] = (sorted(s_cols), sorted(d_cols))
        only_s = sorted(set(sl) - set(dl))[:3]
        only_d = sorted(set(dl) - set(sl))[:3]
        res["only_spark"] = only_s
        res["only_duck"] = only_d
    return res


def main():
    import __spark_entry__ as E
    from buoyline.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session(8, 8)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        try:
            r = check(spark, name, qs[name], os_.get(name), sf_dir)
        except Exception as exc:  # report and go on
            r = {"name": name, "ok": False, "error": str(exc)[:400]}
        if r["ok"] is False:
            bad += 1
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
