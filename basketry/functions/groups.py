"""Item-group generation inside one basket array.

These are higher-order array expressions, evaluated row by row in the JVM.
They suit baskets that already arrive as one array per row (parsed basket
text). Baskets held as one row per order line use the blocked self-join in
``basketry.operators.pairs`` instead, which never gathers a basket in one row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def check_group_size(k) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError(f"group size must be an integer >= 1, got {k!r}")
    return k


def item_groups(items, k: int) -> Column:
    """All k-groups of a basket, as ``array<array<T>>``.

    k = 1: every item as a singleton, in input order (duplicates kept).
    k = 2: every pair of positions i < j of the sorted basket.
    k >= 3: a contiguous run of k-1 sorted items followed by any later item;
    for [2,3,4,5] and k=3 that is 2-3-4, 2-3-5 and 3-4-5 (not 2-4-5).
    A basket shorter than k gives an empty array.
    """
    check_group_size(k)
    arr = _c(items)
    if k == 1:
        return F.transform(arr, lambda x: F.array(x))
    s = F.array_sort(arr)
    n = F.size(s)
    last_base = n - k
    # sequence() counts down when the end is below the start; the filter
    # turns that case into an empty index list.
    starts = F.filter(F.sequence(F.lit(0), last_base),
                      lambda i: (i >= 0) & (i <= last_base))
    return F.flatten(F.transform(
        starts,
        lambda i: F.transform(
            F.sequence(i + (k - 1), n - 1),
            lambda j: F.concat(F.slice(s, i + 1, k - 1), F.array(F.get(s, j))))))


def item_pairs(items) -> Column:
    """G2 as ``array<struct<item1, item2>>`` over sorted positions i < j."""
    s = F.array_sort(_c(items))
    n = F.size(s)
    starts = F.filter(F.sequence(F.lit(0), n - 2), lambda i: (i >= 0) & (i <= n - 2))
    return F.flatten(F.transform(
        starts,
        lambda i: F.transform(
            F.sequence(i + 1, n - 1),
            lambda j: F.struct(F.get(s, i).alias("item1"), F.get(s, j).alias("item2")))))


def group_count(n, k: int) -> Column:
    """Number of k-groups ``item_groups`` yields for a basket of size n."""
    check_group_size(k)
    n = _c(n).cast("bigint")
    if k == 1:
        return n
    if k == 2:
        return F.when(n >= 2, F.shiftright(n * (n - 1), 1)).otherwise(F.lit(0).cast("bigint"))
    m = n - k + 1  # number of bases; base i has m - i later items
    return F.when(n >= k, F.shiftright(m * (m + 1), 1)).otherwise(F.lit(0).cast("bigint"))
