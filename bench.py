"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 BENCH_RUNS=3 python bench.py

Each query is fully evaluated with the ``noop`` sink (no collect), once to
warm up and then ``BENCH_RUNS`` times; the median per query is reported.
Before every timed run the shared tables that queries write (cohort, sessions,
long table) are forgotten, so each run makes its own anew.  The derived answer
log is the published pipeline's input and is kept.
Prints one JSON line.
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "exp_sessions",          # entry 3: SQL session view (30 min)
    "naive_sessions",        # entry 3: 3600-minute variant
    "sessions_user_global",  # entry 1: enrichment + per-user numbering + modes + arrays
    "section_split",         # Q-01
    "prefix_ratio_by_arm",   # Q-09
    "position_curve",        # Q-13
    "gap_curve",             # Q-15
    "did_1_10",              # I-01
    "adjusted_q12",          # I-04
    "log_gap_section_fe",    # I-07
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    from seqlab.plans import pipeline
    from seqlab.plans.registry import QUERIES, load_all
    from seqlab.session import local_session
    load_all()
    spark = local_session(cores=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", cpus)))
    out = {}
    for name in names:
        fn = QUERIES[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up (JIT, file listing)
        times = []
        for _ in range(runs):
            pipeline.reset(inputs=False)
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(times), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_sec", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": sf, "cpus": int(cpus), "runs": runs}))


if __name__ == "__main__":
    main()
