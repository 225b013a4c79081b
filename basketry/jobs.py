"""Batch jobs for spark-submit: the end-to-end runs a user starts from the shell.

    spark-submit --py-files basketry.zip basketry/jobs.py pcy <basket text> <out dir> <support>
                 [--strategy auto|broadcast|shuffle] [--item-mod N]
    ... basketry/jobs.py pairs <basket text> <out dir> <support> [--existing <recs parquet>]
    ... basketry/jobs.py baskets <tables dir> <out dir> [--sep ' : '] [--files N]
    ... basketry/jobs.py fpgrowth <transactions> <out dir> [--min-support 0.3]
    ... basketry/jobs.py recommend <recs parquet> <requests parquet> <catalog parquet> <out>

(``python -m basketry.jobs ...`` does the same on a local session.)
Each job only wires operators together; outputs are overwritten per run.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from basketry.operators.baskets import as_lines, shared_items
from basketry.operators.counting import (frequent_buckets, frequent_pairs, having_support,
                                         shared_item_counts)
from basketry.operators.fpm import fp_growth
from basketry.operators.pairs import expand_occurrences, pair_occurrences
from basketry.operators.recommend import recommendations_from_pairs, upsert_recommendations
from basketry.plans.baskets import order_baskets
from basketry.plans.pcy import filtered_by
from basketry.plans.recommend import respond
from basketry.session import materialized
from basketry.sinks.tables import save_bitmap, save_frequent_items, save_table
from basketry.sinks.text import write_pairs_text
from basketry.sources.text import read_baskets, read_transactions


def run_pcy(spark: SparkSession, input_path: str, out_dir: str, support: int,
            strategy: str = "auto", item_mod: int | None = None) -> dict[str, str]:
    """Basket text -> PCY candidate pairs as text, plus the keyed tables.

    Writes ``items/`` and ``bitmap/`` (the two filters), which are read back as
    the filters of the run, ``pairs/`` (``(a, b)`` lines, one per occurrence),
    ``partners/`` (every pair of different products with its candidate count)
    and ``recommendations/`` (one partner per product: most candidate
    occurrences, then the lowest id). Each is computed once.
    """
    out = {name: os.path.join(out_dir, name)
           for name in ("items", "bitmap", "pairs", "partners", "recommendations")}
    baskets = shared_items(as_lines(read_baskets(spark, input_path)))
    save_frequent_items(having_support(shared_item_counts(baskets, item_mod), support), out["items"])
    save_bitmap(frequent_buckets(pair_occurrences(baskets), support), out["bitmap"])
    filtered = materialized(filtered_by(
        baskets, spark.read.parquet(out["items"]), spark.read.parquet(out["bitmap"]),
        item_mod=item_mod, strategy=strategy), "candidates")
    write_pairs_text(expand_occurrences(filtered), out["pairs"])
    counts = filtered.groupBy("item1", "item2").agg(F.sum("n").alias("support"))
    save_table(recommendations_from_pairs(counts), out["partners"])
    save_table(upsert_recommendations(spark.read.parquet(out["partners"])), out["recommendations"])
    return out


def run_pairs(spark: SparkSession, input_path: str, out_dir: str, support: int,
              existing: str | None = None) -> dict[str, str]:
    """Basket text -> exact frequent pairs, every partner with its support, and the
    one-partner table, merged into the table at ``existing`` if one is given."""
    out = {name: os.path.join(out_dir, name) for name in ("pairs", "partners", "recommendations")}
    save_table(frequent_pairs(as_lines(read_baskets(spark, input_path)), support), out["pairs"])
    recs = recommendations_from_pairs(spark.read.parquet(out["pairs"]))
    save_table(recs, out["partners"])
    before = spark.read.parquet(existing) if existing else None
    save_table(upsert_recommendations(recs, before), out["recommendations"])
    return out


def run_fpgrowth(spark: SparkSession, input_path: str, out_dir: str, min_support: float = 0.3,
                 num_partitions: int | None = None) -> str:
    """Frequent itemsets of space-separated transactions, saved as parquet."""
    sets = fp_growth(read_transactions(spark, input_path), min_support, num_partitions)
    return save_table(sets, out_dir)


def run_recommend(spark: SparkSession, recs_path: str, requests_path: str, catalog_path: str,
                  out_dir: str, k: int = 5) -> str:
    """Responses for a table of requests (``product_id``), saved as parquet."""
    out = respond(spark.read.parquet(requests_path), spark.read.parquet(recs_path),
                  spark.read.parquet(catalog_path), k)
    return save_table(out, out_dir)


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="basketry.jobs")
    sub = p.add_subparsers(dest="job", required=True)
    a = sub.add_parser("pcy")
    a.add_argument("input")
    a.add_argument("output")
    a.add_argument("support", type=int)
    a.add_argument("--strategy", default="auto", choices=["auto", "broadcast", "shuffle"])
    a.add_argument("--item-mod", type=int, default=None)
    e = sub.add_parser("pairs")
    e.add_argument("input")
    e.add_argument("output")
    e.add_argument("support", type=int)
    e.add_argument("--existing", default=None)
    b = sub.add_parser("baskets")
    b.add_argument("tables")
    b.add_argument("output")
    b.add_argument("--sep", default=" : ")
    b.add_argument("--files", type=int, default=None)
    f = sub.add_parser("fpgrowth")
    f.add_argument("input")
    f.add_argument("output")
    f.add_argument("--min-support", type=float, default=0.3)
    f.add_argument("--partitions", type=int, default=None)
    r = sub.add_parser("recommend")
    r.add_argument("recs")
    r.add_argument("requests")
    r.add_argument("catalog")
    r.add_argument("output")
    r.add_argument("--k", type=int, default=5)
    args = p.parse_args(argv)

    from basketry.session import get_session
    spark = get_session(f"basketry-{args.job}")
    if args.job == "pcy":
        run_pcy(spark, args.input, args.output, args.support, args.strategy,
                args.item_mod)
    elif args.job == "pairs":
        run_pairs(spark, args.input, args.output, args.support, args.existing)
    elif args.job == "baskets":
        order_baskets(spark, args.tables, args.output, args.sep, args.files)
    elif args.job == "fpgrowth":
        run_fpgrowth(spark, args.input, args.output, args.min_support, args.partitions)
    else:
        run_recommend(spark, args.recs, args.requests, args.catalog, args.output, args.k)
    return 0


if __name__ == "__main__":
    sys.exit(main())
