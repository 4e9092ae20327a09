"""Print the formatted physical plan of registered queries with a short summary.

    python -m seqlab.plans.explain [--sf DIR] name [name ...]

The summary counts shuffles (Exchange), broadcasts, sort-merge joins, windows
and parquet scans, and lists pushed filters and read schemas, which is what to
check when a plan changes: shuffles only on the keys that need them, no scan
reading unneeded columns, filters reaching the scan.
"""
from __future__ import annotations

import argparse
import collections
import re


def summarize(plan: str) -> dict:
    nodes = collections.Counter(re.findall(r"^\(\d+\) ([A-Za-z]+)", plan, flags=re.M))
    return {
        "exchanges": re.findall(r"Arguments: (hashpartitioning\([^)]*\)|rangepartitioning\([^)]*\)|SinglePartition)", plan),
        "nodes": dict(nodes),
        "pushed_filters": sorted(set(re.findall(r"PushedFilters: (\[[^\]]*\])", plan))),
        "read_schema": sorted(set(re.findall(r"ReadSchema: (\S+)", plan))),
    }


def main(argv=None) -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--full", action="store_true", help="print the whole formatted plan")
    ap.add_argument("names", nargs="+")
    a = ap.parse_args(argv)
    from seqlab.plans.registry import QUERIES, load_all
    from seqlab.session import local_session
    load_all()
    spark = local_session()
    for name in a.names:
        df = QUERIES[name](spark, a.sf)
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted") \
            if hasattr(df._sc._jvm, "PythonSQLUtils") else ""
        if not plan:
            import io
            import contextlib
            buf = io.StringIO()
            with contextlib.redirect_stdout(buf):
                df.explain("formatted")
            plan = buf.getvalue()
        if a.full:
            print(plan)
        s = summarize(plan)
        print(f"== {name}: {len(s['exchanges'])} exchanges, nodes {s['nodes']}")
        for e in s["exchanges"]:
            print("   exchange", e)
        for f in s["pushed_filters"]:
            print("   pushed", f)
        for r in s["read_schema"]:
            print("   reads", r)


if __name__ == "__main__":
    main()
