"""Benchmark the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_SHUFFLE_PARTITIONS (default 2 x cpus),
BENCH_QUERIES (comma list; default the headline set), BENCH_ALL=1 for every
registered query. Each query is run to completion with the ``noop`` sink (no
collect). Before timing, every selected query runs once on the smallest
fixture (BENCH_WARMUP_DIR, default the sibling ``sf0.001`` folder; empty to
skip), so the timed runs measure steady-state work rather than first-time JIT
and code generation. The warm-up is not counted.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from basketry.queries import QUERIES  # noqa: E402
from basketry.session import get_session, ship_package  # noqa: E402

HEADLINE = [
    "order_part_join", "basket_lines", "pcy_candidates", "pcy_candidates_shuffle",
    "frequent_pairs", "frequent_pairs_distinct", "freq_buckets", "rec_enrich",
    "rec_lookup", "fp_growth", "basket_runs", "probe_random_pairs", "page_extract",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = (list(QUERIES) if os.environ.get("BENCH_ALL") == "1"
             else [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q])
    partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(max(cpus * 2, 8))))
    spark = get_session("basketry-bench", master=f"local[{cpus}]",
                        shuffle_partitions=partitions,
                        extra_conf={"spark.driver.memory": "16g",
                                    "spark.sql.execution.arrow.pyspark.enabled": "true"})
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    default_warmup = os.path.join(os.path.dirname(os.path.normpath(sf_dir)), "sf0.001")
    warmup_dir = os.environ.get("BENCH_WARMUP_DIR", default_warmup)
    if warmup_dir and os.path.isdir(warmup_dir):
        for name in names:
            QUERIES[name](spark, warmup_dir).write.format("noop").mode("overwrite").save()
    else:
        warmup_dir = ""
        QUERIES["pair_count"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir,
                      "warmup": warmup_dir or "pair_count"}))
    spark.stop()


if __name__ == "__main__":
    main()
