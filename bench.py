"""Benchmark the headline queries.

Runs each query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
(default 8) and prints one JSON line:
  {"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed in full through the ``noop`` sink (every row is produced, nothing
is collected to the driver). One query per family (trade, crime, text) is first run at
sf0.001 to warm the JVM (JIT, regex compilation); the warm-up is not timed.
Set BENCH_QUERIES=a,b,c to pick queries, or BENCH_ALL=1 to time every registered query. Writing the yearly files
that the crime keys read is timed as its own line, crime_files.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "trade_decomposition",   # flagship: panel windows, yearly aggregate, chained index
    "decomp_periods",
    "decomp_long",
    "asg_population",        # fixed-width multi-file ingest + log growth
    "crime_panel_final",     # linkage + 14 log differences + dense ids
    "panel_dlog_many",       # sparse customer panel, one window node for 4 series
    "index_to_base",
    "word_counts",           # tokenise + count over whole texts
    "zipf_rank",             # distributed rank within document
    "tf_idf",
    "tfidf_top_terms",
    "topic_top_terms",       # topics: variational fit until its bound settles
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from panelspark.session import local_session
    from panelspark.registry import QUERIES, crime_files

    spark = local_session(cores=cpus, shuffle_partitions=max(cpus, 8), app="panelspark-bench")
    if os.environ.get("BENCH_ALL"):
        names = sorted(QUERIES)
    elif os.environ.get("BENCH_QUERIES"):
        names = [q.strip() for q in os.environ["BENCH_QUERIES"].split(",") if q.strip()]
    else:
        names = HEADLINE

    warm = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(warm):
        for q in ("trade_decomposition", "crime_panel_final", "word_counts"):
            QUERIES[q](spark, warm).write.format("noop").mode("overwrite").save()

    timings: dict[str, float] = {}
    if {"asg_population", "crime_panel_final"} & set(names):  # the yearly files, written once a session
        t0 = time.perf_counter()
        crime_files(spark, sf_dir)
        timings["crime_files"] = round(time.perf_counter() - t0, 3)
        print(f"crime_files: {timings['crime_files']}s", file=sys.stderr, flush=True)
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {timings[name]}s", file=sys.stderr, flush=True)

    m = re.search(r"sf([0-9.]+)$", sf_dir)
    out = {
        "metric": "total_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
