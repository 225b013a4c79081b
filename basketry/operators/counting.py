"""Support counting: buckets (A1, A3), items (A2), pair totals (A4), exact pairs.

All counts are ordinary ``groupBy`` aggregates, so partial counts are merged
map-side before the shuffle and a hot key (one very popular item or bucket)
shrinks to one partial row per map task. The support test is strict:
``count > support`` (support 0 means "seen at least once").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.groups import group_count
from basketry.functions.hashes import PAIR_BUCKETS, hash_pair, hash_single
from basketry.operators.baskets import as_lines, basket_items, is_array_baskets, shared_items
from basketry.operators.membership import keep_members, prepare_side, side_strategy
from basketry.operators.pairs import DEFAULT_BLOCK_SIZE, dealt_pairs, pair_occurrences
from basketry.session import materialized


def having_support(counts: DataFrame, support: int, count_col: str = "support") -> DataFrame:
    """Keep groups whose count is strictly above ``support``."""
    return counts.where(F.col(count_col) > F.lit(support))


def bucket_counts(groups: DataFrame, bucket: Column, weight: str | None = None) -> DataFrame:
    """A1: ``(bucket, support)``: groups (weighted by ``weight``) per hash bucket."""
    agg = F.sum(weight) if weight else F.count(F.lit(1))
    return groups.groupBy(bucket.alias("bucket")).agg(agg.cast("bigint").alias("support"))


def item_counts(baskets: DataFrame, item_mod: int | None = None) -> DataFrame:
    """``(item, support)`` over all order lines; ``item_mod`` applies the single hash."""
    lines = as_lines(baskets)
    return (lines.groupBy(hash_single(F.col("item"), item_mod).alias("item"))
            .agg(F.count(F.lit(1)).alias("support")))


def frequent_items(baskets: DataFrame, support: int, item_mod: int | None = None) -> DataFrame:
    """A2: items (or single hashes, with ``item_mod``) with count > support."""
    return having_support(item_counts(baskets, item_mod), support)


def shared_item_counts(baskets: DataFrame, item_mod: int | None = None) -> DataFrame:
    """``item_counts`` for plans that also make pairs from the same baskets.

    For lines the counts are summed from the per-basket multiplicities
    ``(order_id, item, mult)`` that pair generation reads too. Arrays are
    counted directly (their pairs need no shuffle).
    """
    if is_array_baskets(baskets):
        return item_counts(baskets, item_mod)
    return (basket_items(baskets).groupBy(hash_single(F.col("item"), item_mod).alias("item"))
            .agg(F.sum("mult").cast("bigint").alias("support")))


def pair_buckets(pairs: DataFrame, num_buckets: int = PAIR_BUCKETS) -> DataFrame:
    return pairs.withColumn("bucket", hash_pair("item1", "item2", num_buckets))


def frequent_buckets(pairs: DataFrame, support: int,
                     num_buckets: int = PAIR_BUCKETS) -> DataFrame:
    """A3: pair buckets whose pair count is > support (the PCY bitmap)."""
    if "bucket" not in pairs.columns:
        pairs = pair_buckets(pairs, num_buckets)
    return having_support(bucket_counts(pairs, F.col("bucket"), "n"), support)


def pair_count(baskets: DataFrame) -> DataFrame:
    """A4: total pair occurrences, in closed form ``sum n(n-1)/2`` over basket sizes."""
    if is_array_baskets(baskets):
        sizes = baskets.select(F.size("items").alias("size"))
    else:
        size = F.sum("mult") if "mult" in baskets.columns else F.count(F.lit(1))
        sizes = baskets.groupBy("order_id").agg(size.alias("size"))
    return sizes.agg(F.coalesce(F.sum(group_count("size", 2)), F.lit(0))
                     .cast("bigint").alias("pair_count"))


def bucket_prefilter_pays(baskets: DataFrame, support: int,
                          num_buckets: int = PAIR_BUCKETS) -> bool:
    """Whether the PCY bucket filter can remove pairs at this data size.

    ``P`` pair occurrences fall into ``num_buckets`` buckets, ``P / B`` per
    bucket on average. Once that is above ``support + 1`` almost every bucket
    is frequent and the filter removes almost nothing, while it costs a second
    pass of pair generation; at large scale that is the normal case. ``P``
    comes from ``pair_count`` in closed form (basket sizes only, no pairs), so
    this runs one small aggregate job and brings one number to the driver.
    """
    total = pair_count(baskets).first()["pair_count"]
    return total < num_buckets * (support + 1)


def frequent_pairs(baskets: DataFrame, support: int, distinct_items: bool = False,
                   bucket_prefilter: bool | str = False, num_buckets: int = PAIR_BUCKETS,
                   strategy: str = "auto",
                   block_size: int | None = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """Exact pair support ``(item1, item2, support)`` with support > ``support``.

    Counts pair occurrences: with repeated items in a basket a pair counts once
    per position pair (the reference's rule); ``distinct_items=True`` counts
    baskets instead. Two prunings cut the pairs before the big shuffle:

    * bucket prefilter (always exact, off by default): a pair's count is at most
      its bucket's count, so pairs in infrequent buckets cannot pass. It makes
      the pairs twice. ``"auto"`` uses it only where ``bucket_prefilter_pays``;
    * item prefilter (a-priori, only with ``distinct_items``): a pair's basket
      count is at most each item's basket count, so lines of infrequent items
      are dropped before any pair is made.
    """
    if distinct_items:
        lines = shared_items(as_lines(baskets)).withColumn("mult", F.lit(1).cast("bigint"))
        if support > 0:
            items = prepare_side(having_support(item_counts(lines), support), "item", side_strategy(strategy, lines))
            lines = materialized(keep_members(lines, "item", items), "frequent-lines")
    else:
        lines = baskets = shared_items(baskets)
    pairs = pair_occurrences(lines, block_size)
    if bucket_prefilter == "auto":
        bucket_prefilter = support > 0 and bucket_prefilter_pays(baskets, support, num_buckets)
    elif not isinstance(bucket_prefilter, bool):
        raise ValueError(f"bucket_prefilter must be True, False or 'auto', got {bucket_prefilter!r}")
    if bucket_prefilter and support > 0:
        pairs = pair_buckets(pairs, num_buckets)
        buckets = prepare_side(frequent_buckets(pairs, support), "bucket", strategy,
                               bound_rows=num_buckets)
        pairs = keep_members(pairs, "bucket", buckets)
    counts = (dealt_pairs(pairs, lines, "item1", "item2").groupBy("item1", "item2")
              .agg(F.sum("n").cast("bigint").alias("support")))
    return having_support(counts, support)
