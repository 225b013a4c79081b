"""PCY (Park-Chen-Yu) candidate pairs (C1) and the general pass n.

``pcy_candidates`` reproduces the reference's rows: every pair occurrence
whose two items are frequent and whose bucket is frequent, with no second
counting pass (so bucket collisions give false positives and a pair repeats
once per basket). ``basketry.operators.counting.frequent_pairs`` adds the
exact count.

Plan: the items of each basket are computed once and written to shared
scratch. From them come the item counts, the bucket counts (which need all
pairs) and the output pairs, which are made from frequent items alone, since
both items of a candidate must be frequent. The bucket filter has at most
``num_buckets`` keys, a proven bound, so it may be broadcast. ``item_mod``
reproduces the reference's single hash, which merges ids that agree modulo it;
``None`` (the default) counts items as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.bitmaps import bitmap_table, bitmap_words, in_bitmap
from basketry.functions.groups import check_group_size
from basketry.functions.hashes import PAIR_BUCKETS, SINGLE_MOD, hash_group, hash_single_group
from basketry.operators.baskets import is_array_baskets, shared_items
from basketry.operators.counting import (bucket_counts, frequent_buckets, having_support,
                                         pair_buckets, shared_item_counts)
from basketry.operators.membership import check_strategy, keep_members, prepare_side, side_strategy
from basketry.operators.pairs import (DEFAULT_BLOCK_SIZE, basket_groups, dealt_pairs, expand_occurrences,
                                      pair_occurrences, ranked_items)
from basketry.session import materialized
from basketry.sinks.store import frequent_lines


def pcy_filtered_pairs(baskets: DataFrame, support: int, num_buckets: int = PAIR_BUCKETS,
                       item_mod: int | None = None, strategy: str = "auto",
                       block_size: int | None = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """Candidate pairs with multiplicity: ``(order_id, item1, item2, n, bucket)``."""
    check_strategy(strategy)
    baskets = shared_items(baskets)
    items = having_support(shared_item_counts(baskets, item_mod), support)
    all_pairs = pair_buckets(pair_occurrences(baskets, block_size), num_buckets)
    return filtered_by(baskets, items, frequent_buckets(all_pairs, support), num_buckets, item_mod,
                       strategy, block_size)


def pcy_distinct_pairs(baskets: DataFrame, support: int, **kw) -> DataFrame:
    """Each candidate pair once: ``(item1, item2)``. Options as for ``pcy_filtered_pairs``."""
    baskets = shared_items(baskets)
    pairs = pcy_filtered_pairs(baskets, support, **kw).select("item1", "item2")
    return dealt_pairs(pairs, baskets, "item1", "item2").distinct()


def filtered_by(baskets: DataFrame, items: DataFrame, buckets: DataFrame,
                num_buckets: int = PAIR_BUCKETS, item_mod: int | None = None,
                strategy: str = "auto", block_size: int | None = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """Pairs of ``baskets`` whose items are in ``items.item`` and whose bucket is in
    ``buckets.bucket``: given tables, for example ones saved by an earlier run."""
    # With item_mod the frequent keys are hashes compared with raw items (the
    # reference's rule): at most item_mod of them.
    hashed = item_mod is None and not is_array_baskets(baskets) and "mult" in baskets.columns
    side = prepare_side(items, "item", side_strategy(strategy, baskets) if hashed else strategy, bound_rows=item_mod)
    bucket_side = prepare_side(buckets, "bucket", strategy, bound_rows=num_buckets)
    if is_array_baskets(baskets):
        pairs = pair_buckets(pair_occurrences(baskets, block_size), num_buckets)
        pairs = keep_members(keep_members(pairs, "item1", side), "item2", side)
    else:
        kept = materialized(keep_members(shared_items(baskets), "item", side), "kept-items")
        pairs = pair_buckets(pair_occurrences(kept, block_size), num_buckets)
    return keep_members(pairs, "bucket", bucket_side)


def bitmap_filtered_pairs(baskets: DataFrame, bitmap: DataFrame, num_buckets: int = PAIR_BUCKETS,
                          block_size: int | None = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """Pairs of ``baskets`` whose bucket is in a bitmap table: the bit is tested by an expression, so
    no join on the bucket takes place."""
    pairs = pair_buckets(pair_occurrences(baskets, block_size), num_buckets)
    return pairs.where(in_bitmap(bitmap_words(bitmap, num_buckets), F.col("bucket")))


def pcy_candidates_bitmap(baskets: DataFrame, support: int, num_buckets: int = PAIR_BUCKETS,
                          item_mod: int | None = None, strategy: str = "auto",
                          block_size: int | None = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """C1 with the bucket filter as a bitmap: the same rows as ``pcy_candidates``."""
    baskets = shared_items(baskets)
    items = having_support(shared_item_counts(baskets, item_mod), support)
    side = prepare_side(items, "item", strategy, bound_rows=item_mod)
    buckets = frequent_buckets(pair_buckets(pair_occurrences(baskets, block_size), num_buckets), support)
    bitmap = materialized(bitmap_table(buckets), "bitmap")
    if is_array_baskets(baskets):
        pairs = bitmap_filtered_pairs(baskets, bitmap, num_buckets, block_size)
        pairs = keep_members(keep_members(pairs, "item1", side), "item2", side)
    else:
        pairs = bitmap_filtered_pairs(keep_members(baskets, "item", side), bitmap, num_buckets, block_size)
    return expand_occurrences(pairs)


def pcy_candidates(baskets: DataFrame, support: int, num_buckets: int = PAIR_BUCKETS,
                   item_mod: int | None = None, strategy: str = "auto",
                   block_size: int | None = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """The reference's frequent-pair rows ``(order_id, item1, item2)``.

    ``baskets`` is either lines ``(order_id, item)`` or arrays
    ``(order_id, items)``. One row per pair occurrence.
    """
    return expand_occurrences(pcy_filtered_pairs(baskets, support, num_buckets, item_mod,
                                                 strategy, block_size))


def pcy_pass(baskets: DataFrame, n: int, support: int,
             hash_n: Callable[[Column], Column] | None = None,
             hash_n1: Callable[[Column], Column] | None = None,
             block_size: int | None = DEFAULT_BLOCK_SIZE):
    """Pass n of PCY, for any n >= 1, on lines or basket arrays.

    Returns ``(frequent_n, bitmap_n1, groups_n1)``: hashes of the n-groups with count > support,
    buckets of the (n+1)-groups with count > support, and the (n+1)-groups themselves
    ``(order_id, group)``. Default hashes are the reference's: plain product mod 1e8 for n-groups,
    product of (2x+1) mod 999917 for (n+1)-groups. The items of each basket (from n = 2 on with
    their positions) are written to shared scratch once and shared by all three results; groups carry
    their occurrence count, so counts are weighted sums.
    """
    check_group_size(n)
    hash_n = hash_n or (lambda g: hash_single_group(g, SINGLE_MOD))
    hash_n1 = hash_n1 or (lambda g: hash_group(g, PAIR_BUCKETS))
    baskets, ranked = shared_items(baskets), None
    if n > 1 and not is_array_baskets(baskets):
        ranked = ranked_items(baskets)
    lower = basket_groups(baskets, n, block_size, ranked)
    upper = basket_groups(baskets, n + 1, block_size, ranked)
    hashes = lower.select(hash_n(F.col("group")).alias("_hash"), "n")
    if n > 1:  # a basket's n-groups are base positions with a later item: about as many as its pairs
        hashes = dealt_pairs(hashes, baskets, "_hash", items_only=False)
    frequent_n = having_support(bucket_counts(hashes, F.col("_hash"), "n"), support)
    bitmap_n1 = having_support(bucket_counts(upper, hash_n1(F.col("group")), "n"), support)
    return frequent_n, bitmap_n1, expand_occurrences(upper, ["order_id", "group"])


def pcy_candidates_from_store(store, block_size: int | None = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """C1 in store mode: candidate pairs of a store (``sinks.store``), as ``pcy_candidates`` gives them.

    The basket items meet the frequent items without an exchange of either; only what is left is dealt
    out by basket for pairing.
    """
    kept = materialized(frequent_lines(store), "frequent-lines")
    return expand_occurrences(bitmap_filtered_pairs(kept, store.bitmap, store.num_buckets, block_size))
