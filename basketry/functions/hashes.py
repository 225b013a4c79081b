"""Hash functions over items, pairs and item groups, as Column expressions.

Every function returns a ``Column`` so hashing stays inside whole-stage
codegen. Products are reduced modulo the bucket count after every factor
(``pmod``), which gives the same non-negative result as reducing the exact
product once, while never overflowing a 64-bit long for moduli below 3e9.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference for identical buckets:
#   pair-hash modulus 999917 (a prime), the product of (2*item + 1) per group;
#   single-item modulus 100000000, the plain product per group;
#   alternative pair hashes modulo 25 (plain product) and 1000 (i * j).
PAIR_BUCKETS = 999917
SINGLE_MOD = 100000000
ALT_PAIR_MOD = 25
PROBE_MOD = 1000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _one() -> Column:
    return F.lit(1).cast("bigint")


def hash_single(items, mod: int | None = SINGLE_MOD) -> Column:
    """H1: product of the items modulo ``mod`` (the reference's single hash).

    ``items`` may be an array column (a group) or a scalar item column. With
    ``mod=None`` a scalar item is returned unchanged (the raw key).
    """
    col = _c(items)
    if mod is None:
        return col
    return F.pmod(col.cast("bigint"), F.lit(mod))


def hash_single_group(items, mod: int = SINGLE_MOD) -> Column:
    """H1 over an array: product of all elements modulo ``mod``; 1 for []."""
    return F.aggregate(_c(items), _one(),
                       lambda acc, x: F.pmod(acc * F.pmod(x.cast("bigint"), F.lit(mod)),
                                             F.lit(mod)))


def hash_pair(a, b, num_buckets: int = PAIR_BUCKETS) -> Column:
    """H2: (2a+1)(2b+1) mod num_buckets, order-free."""
    m = F.lit(num_buckets)
    fa = F.pmod(_c(a).cast("bigint") * 2 + 1, m)
    fb = F.pmod(_c(b).cast("bigint") * 2 + 1, m)
    return F.pmod(fa * fb, m)


def hash_group(items, num_buckets: int = PAIR_BUCKETS) -> Column:
    """H2 generalised to a k-group array: product of (2x+1) mod num_buckets."""
    m = F.lit(num_buckets)
    return F.aggregate(_c(items), _one(),
                       lambda acc, x: F.pmod(acc * F.pmod(x.cast("bigint") * 2 + 1, m), m))


def hash_pair_25(a, b) -> Column:
    """H3: a*b mod 25."""
    m = F.lit(ALT_PAIR_MOD)
    return F.pmod(F.pmod(_c(a).cast("bigint"), m) * F.pmod(_c(b).cast("bigint"), m), m)


def hash_pair_1000(a, b) -> Column:
    """H4: a*b mod 1000 (the probe script's bucket)."""
    m = F.lit(PROBE_MOD)
    return F.pmod(F.pmod(_c(a).cast("bigint"), m) * F.pmod(_c(b).cast("bigint"), m), m)
