"""Run one registered query and print its final adaptive physical plan.

Usage: python tools/show_plan.py <name> [sf_dir]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from basketry.queries import QUERIES  # noqa: E402
from basketry.session import get_session  # noqa: E402


def main():
    name = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    spark = get_session(master="local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    df = QUERIES[name](spark, sf_dir)
    qe = df._jdf.queryExecution()
    t0 = time.perf_counter()
    n = qe.executedPlan().execute().count()
    print(f"-- {name}: {n} rows in {time.perf_counter() - t0:.2f}s")
    print(qe.executedPlan().toString())


if __name__ == "__main__":
    main()
