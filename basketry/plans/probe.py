"""Probe random pairs against the stored filters and count the hits.

The reference zips two random permutations of 1..n on one machine and runs
three point queries per pair. Here the pairs come from ``spark.range``: the
first member is the id and the second an affine permutation of it,
``((i * a + c) mod n) + 1`` with ``gcd(a, n) = 1``, so no list is built on the
driver and no positional zip join is needed. Membership is three semi joins.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.bitmaps import bitmap_words, in_bitmap
from basketry.functions.hashes import hash_pair_1000
from basketry.operators.membership import keep_members, prepare_side


def coprime_multiplier(n: int, start: int = 719) -> int:
    """Smallest multiplier >= start that is coprime with n."""
    a = max(start, 1)
    while gcd(a, n) != 1:
        a += 1
    return a


def probe_pairs(spark: SparkSession, n: int, a: int = 719, c: int = 13) -> DataFrame:
    """``(i, j)`` for i in 1..n with j a permutation of 1..n."""
    if gcd(a, n) != 1:
        raise ValueError(f"multiplier {a} is not coprime with {n}")
    a_red = a % n
    ids = spark.range(1, n + 1)
    return ids.select(F.col("id").alias("i"),
                      (F.pmod(F.col("id") * F.lit(a_red) + F.lit(c), F.lit(n)) + 1).alias("j"))


def probe_hits(spark: SparkSession, items: DataFrame, buckets: DataFrame, n: int,
               a: int = 719, c: int = 13, hash_fn=hash_pair_1000,
               strategy: str = "auto") -> DataFrame:
    """One row ``(probes, hits)``: pairs with both items in ``items.item`` and
    ``hash_fn(i, j)`` in ``buckets.bucket``."""
    pairs = probe_pairs(spark, n, a, c).withColumn("bucket", hash_fn("i", "j"))
    item_side = prepare_side(items, "item", strategy)
    hits = keep_members(pairs, "i", item_side)
    hits = keep_members(hits, "j", item_side)
    hits = keep_members(hits, "bucket", prepare_side(buckets, "bucket", strategy))
    return hits.agg(F.lit(n).cast("bigint").alias("probes"),
                    F.count(F.lit(1)).alias("hits"))


def probe_store(store, n: int, a: int = 719, c: int = 13, hash_fn=hash_pair_1000) -> DataFrame:
    """One row ``(probes, hits, hit_rate)``: C6 against a saved store (``sinks.store``).

    The bucket is tested first, by the stored bitmap's bits; the probes that pass meet the stored items,
    which are read where they lie (bucketed by item), so only probes move.
    """
    pairs = probe_pairs(store.items.sparkSession, n, a, c).withColumn("bucket", hash_fn("i", "j"))
    hits = pairs.where(in_bitmap(bitmap_words(store.bitmap, store.num_buckets), F.col("bucket")))
    for member in ("i", "j"):
        side = store.items.select(F.col("item").alias("_member")).hint("merge")
        hits = hits.join(side, hits[member] == side["_member"], "left_semi")
    total = F.lit(n).cast("bigint")
    return hits.agg(total.alias("probes"), F.count(F.lit(1)).alias("hits"),
                    (F.count(F.lit(1)) / F.greatest(total, F.lit(1))).alias("hit_rate"))
