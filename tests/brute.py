"""Plain-Python statements of the semantics, used as test oracles."""

from collections import Counter
from math import ceil


def groups(basket, k):
    """k-groups of one basket: contiguous sorted base of k-1 plus any later item."""
    if k == 1:
        return [(x,) for x in basket]
    if len(basket) < k:
        return []
    s = sorted(basket)
    out = []
    for i in range(len(s) - k + 1):
        base = tuple(s[i:i + k - 1])
        out += [base + (x,) for x in s[i + k - 1:]]
    return out


def pair_hash(pair, m=999917):
    prod = 1
    for x in pair:
        prod *= 2 * x + 1
    return prod % m


def single_hash(group, m=100000000):
    prod = 1
    for x in group:
        prod *= x
    return prod % m


def pcy_rows(baskets, support, m=999917, item_mod=100000000):
    """Reference rows: (order_id, a, b) per pair occurrence passing items and buckets."""
    item_counts = Counter(single_hash((x,), item_mod) if item_mod else x
                          for b in baskets.values() for x in b)
    freq_items = {k for k, c in item_counts.items() if c > support}
    pairs = [(oid, p) for oid, b in baskets.items() for p in groups(b, 2)]
    bucket_counts = Counter(pair_hash(p, m) for _, p in pairs)
    freq_buckets = {k for k, c in bucket_counts.items() if c > support}
    return sorted((oid, a, b) for oid, (a, b) in pairs
                  if a in freq_items and b in freq_items and pair_hash((a, b), m) in freq_buckets)


def pair_supports(baskets, distinct_items=False):
    c = Counter()
    for b in baskets.values():
        c.update(groups(sorted(set(b)) if distinct_items else b, 2))
    return c


def frequent_pairs(baskets, support, distinct_items=False):
    return sorted((a, b, n) for (a, b), n in pair_supports(baskets, distinct_items).items()
                  if n > support)


def min_count(min_support, n):
    return ceil(min_support * n)
