"""Compare registered Spark queries with their DuckDB oracle (like the driver does).

    python -m seqlab.plans.check [--sf DIR] [name ...]
"""
from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

from seqlab.sources.tables import TABLES


def _norm(v):
    if v is None:
        return "None"
    try:
        import pandas as pd
        if v is pd.NaT or v is pd.NA:
            return "None"
    except Exception:  # pragma: no cover
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return "None"
        r = round(v, 6)
        return repr(0.0 if r == 0 else r)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, bool):
        return repr(int(v))
    if isinstance(v, int):
        return repr(v)
    return str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    s = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    if sql is None:
        return {"name": name, "rows": len(s), "oracle": None, "spark_s": round(t1 - t0, 2)}
    d = con.sql(sql).df()
    sc, sr = rows_of(s)
    dc, dr = rows_of(d)
    res = {"name": name, "rows": len(s), "oracle_rows": len(d), "cols_ok": sc == dc,
           "values_ok": sr == dr, "spark_s": round(t1 - t0, 2)}
    if not (res["cols_ok"] and res["values_ok"]):
        res["spark_cols"], res["oracle_cols"] = sc, dc
        diff_s = [r for r in sr if r not in set(dr)][:3]
        diff_d = [r for r in dr if r not in set(sr)][:3]
        res["only_spark"], res["only_oracle"] = diff_s, diff_d
    return res


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args(argv)
    from seqlab.plans.registry import ORACLE, QUERIES, load_all
    from seqlab.session import local_session
    load_all()
    spark = local_session()
    con = duck(a.sf)
    bad = 0
    for name in a.names or list(QUERIES):
        try:
            r = compare(spark, con, name, QUERIES[name], ORACLE.get(name), a.sf)
        except Exception as e:  # report and continue
            r = {"name": name, "error": (type(e).__name__ + ": " + str(e))[:800]}
        ok = r.get("oracle") is None and "error" not in r and "values_ok" not in r or (
            r.get("cols_ok") and r.get("values_ok"))
        bad += not ok
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{len(a.names or QUERIES) - bad} ok, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
