import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from basketry.operators.counting import (bucket_prefilter_pays, frequent_buckets,
                                         frequent_items, frequent_pairs, pair_count)
from basketry.operators.pairs import (array_pair_occurrences, expand_occurrences,
                                      group_occurrences, pair_occurrences, ranked_items,
                                      self_join_pair_occurrences)
from basketry.plans.pcy import pcy_candidates, pcy_pass
from tests import brute
from tests.conftest import arrays_df, lines_df


def _occ(df):
    return sorted((r.order_id, r.item1, r.item2) for r in expand_occurrences(df).collect())


def _brute_occ(baskets):
    return sorted((oid, a, b) for oid, b_ in baskets.items() for a, b in brute.groups(b_, 2))


def _random_baskets(seed, n=60, max_item=15, big=None):
    rng = random.Random(seed)
    out = {i: [rng.randrange(0, max_item) for _ in range(rng.randrange(0, 8))] for i in range(n)}
    if big:
        out[n] = [rng.randrange(0, big * 2) for _ in range(big)]
    return out


def test_pair_paths_agree_with_brute_force(spark):
    baskets = _random_baskets(1, big=300)
    lines = lines_df(spark, baskets)
    expect = _brute_occ(baskets)
    assert _occ(self_join_pair_occurrences(lines)) == expect
    assert _occ(self_join_pair_occurrences(lines, None)) == expect
    # force the blocked path: every basket above 8 items is split into blocks
    assert _occ(self_join_pair_occurrences(lines, block_size=8, sample_fraction=1.0)) == expect
    assert _occ(array_pair_occurrences(arrays_df(spark, baskets))) == expect
    # arrays above block_size leave the in-row path for the self-join
    assert _occ(pair_occurrences(arrays_df(spark, baskets), block_size=5)) == expect
    assert pair_count(lines).first().pair_count == len(expect)
    assert pair_count(arrays_df(spark, baskets)).first().pair_count == len(expect)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.integers(0, 50), st.lists(st.integers(0, 9), max_size=7),
                       min_size=1, max_size=12))
def test_blocked_pairs_property(spark, baskets):
    lines = lines_df(spark, baskets)
    got = _occ(self_join_pair_occurrences(lines, block_size=2, sample_fraction=1.0))
    assert got == _brute_occ(baskets)


@pytest.mark.parametrize("support", [0, 1, 2, 3])
@pytest.mark.parametrize("strategy", ["auto", "broadcast", "shuffle"])
def test_pcy_candidates_match_reference_rows(spark, support, strategy):
    baskets = _random_baskets(7)
    got = pcy_candidates(lines_df(spark, baskets), support, strategy=strategy)
    assert sorted(tuple(r) for r in got.collect()) == brute.pcy_rows(baskets, support)


def test_pcy_on_arrays_equals_lines(spark):
    baskets = _random_baskets(8)
    a = pcy_candidates(arrays_df(spark, baskets), 1).collect()
    b = pcy_candidates(lines_df(spark, baskets), 1).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) == brute.pcy_rows(baskets, 1)


def test_support_is_strict(spark):
    baskets = {1: [1, 2], 2: [1, 2], 3: [1, 3]}
    items = {r.item: r.support for r in frequent_items(lines_df(spark, baskets), 2).collect()}
    assert items == {1: 3}  # item 2 has count exactly 2: not above the threshold
    assert frequent_pairs(lines_df(spark, baskets), 1).collect()[0][:] == (1, 2, 2)
    assert frequent_pairs(lines_df(spark, baskets), 2).count() == 0


def test_bucket_collision_gives_false_positive(spark):
    # with 3 buckets pairs (1,2) and (4,5) share bucket (3*5) % 3 = 0 = (9*11) % 3
    baskets = {1: [1, 2], 2: [4, 5], 3: [1, 4], 4: [2, 5]}
    got = pcy_candidates(lines_df(spark, baskets), 1, num_buckets=3)
    rows = sorted((r.item1, r.item2) for r in got.collect())
    assert (1, 2) in rows  # its own count is 1, not above support 1: a false positive
    assert frequent_pairs(lines_df(spark, baskets), 1).count() == 0
    assert rows == sorted((a, b) for _, a, b in brute.pcy_rows(baskets, 1, m=3))


def test_large_item_ids_never_pass_with_item_mod(spark):
    big = 100000000 + 3
    baskets = {i: [3, big] for i in range(5)}
    assert pcy_candidates(lines_df(spark, baskets), 0, item_mod=100000000).count() == 0
    assert pcy_candidates(lines_df(spark, baskets), 0, item_mod=None).count() == 5


def test_item_zero_and_duplicates(spark):
    baskets = {1: [0, 0, 7], 2: [0, 7]}
    got = _occ(self_join_pair_occurrences(lines_df(spark, baskets)))
    assert got == [(1, 0, 0), (1, 0, 7), (1, 0, 7), (2, 0, 7)]


@pytest.mark.parametrize("distinct", [False, True])
@pytest.mark.parametrize("support", [0, 1, 2])
def test_frequent_pairs_exact(spark, distinct, support):
    baskets = _random_baskets(11, max_item=9)
    got = frequent_pairs(lines_df(spark, baskets), support, distinct_items=distinct)
    assert sorted(tuple(r) for r in got.collect()) == \
        brute.frequent_pairs(baskets, support, distinct)


def test_candidates_superset_of_frequent_pairs_on_distinct_baskets(spark):
    baskets = {k: sorted(set(v)) for k, v in _random_baskets(12, max_item=8).items()}
    lines = lines_df(spark, baskets)
    for s in (0, 1, 2):
        cand = {(r.item1, r.item2) for r in pcy_candidates(lines, s, item_mod=None).collect()}
        exact = {(r.item1, r.item2) for r in frequent_pairs(lines, s).collect()}
        assert exact <= cand


def test_frequent_buckets_counts(spark):
    baskets = _random_baskets(13)
    pairs = self_join_pair_occurrences(lines_df(spark, baskets))
    got = {r.bucket: r.support for r in frequent_buckets(pairs, 1).collect()}
    from collections import Counter
    c = Counter(brute.pair_hash(p) for b in baskets.values() for p in brute.groups(b, 2))
    assert got == {k: v for k, v in c.items() if v > 1}


def test_pcy_pass_n2(spark):
    baskets = _random_baskets(14, max_item=6)
    freq2, bitmap3, groups3 = pcy_pass(arrays_df(spark, baskets), 2, 1)
    from collections import Counter
    g2 = Counter(brute.single_hash(g) for b in baskets.values() for g in brute.groups(b, 2))
    g3 = Counter(brute.pair_hash(g) for b in baskets.values() for g in brute.groups(b, 3))
    assert {r.bucket: r.support for r in freq2.collect()} == {k: v for k, v in g2.items() if v > 1}
    assert {r.bucket: r.support for r in bitmap3.collect()} == \
        {k: v for k, v in g3.items() if v > 1}
    assert groups3.count() == sum(len(brute.groups(b, 3)) for b in baskets.values())


@pytest.mark.parametrize("n,block_size", [(2, 4096), (3, 4096), (4, 4096), (3, 4)])
def test_pcy_pass_n_lines_equals_arrays(spark, n, block_size):
    """For any n; the small block size also sends larger arrays through the lines path."""
    baskets = _random_baskets(16, max_item=5)
    a = pcy_pass(arrays_df(spark, baskets), n, 1, block_size=None)
    b = pcy_pass((lines_df if block_size > 9 else arrays_df)(spark, baskets), n, 1, block_size=block_size)
    assert a[2].count() == sum(len(brute.groups(x, n + 1)) for x in baskets.values()) > 0
    for x, y in zip(a[:2], b[:2]):
        assert sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect()))
    key = lambda r: (r.order_id, tuple(r.group))
    assert sorted(map(key, a[2].collect())) == sorted(map(key, b[2].collect()))


def _groups_of(df, k):
    cols = [f"item{t}" for t in range(1, k + 1)]
    return sorted(tuple(r) for r in expand_occurrences(df, ("order_id", *cols)).collect())


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 7])
def test_groups_on_lines_agree_with_brute_force(spark, k):
    # few distinct items, so baskets repeat items often (groups of one item, runs)
    baskets = _random_baskets(17, max_item=4, big=40)
    baskets |= {1000: [3] * 9, 1001: [2, 3, 4, 5], 1002: [9], 1003: list(range(30, 0, -1))}
    lines = lines_df(spark, baskets).repartition(7)
    expect = sorted((oid, *g) for oid, b in baskets.items() for g in brute.groups(b, k))
    for block_size in (4096, None, 3, 1):
        assert _groups_of(group_occurrences(lines, k, block_size), k) == expect, block_size


def test_ranks_of_a_basket_over_many_chunks(spark):
    """A basket in every range partition is counted up through all of them."""
    items = [(i * 7919) % 5000 for i in range(5000)] + [17] * 70_000
    baskets = {1: items, 2: [5, 5, 1]}
    rows = ranked_items(lines_df(spark, baskets)).collect()
    for order, basket in baskets.items():
        ordered, at = sorted(basket), {}
        for i, x in enumerate(ordered):
            at.setdefault(x, i)
        got = {r.item: (r["first"], r.mult, r.size) for r in rows if r.order_id == order}
        assert got == {x: (i, basket.count(x), len(basket)) for x, i in at.items()}
    from basketry.operators import pairs
    assert pairs._positions(ranked_items(lines_df(spark, {1: [4] * 70_000}))).distinct().count() == 70_000


def test_pcy_pass_1_lines_equals_arrays(spark):
    baskets = _random_baskets(15)
    a = pcy_pass(arrays_df(spark, baskets), 1, 1)
    b = pcy_pass(lines_df(spark, baskets), 1, 1)
    for x, y in zip(a[:2], b[:2]):
        assert sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect()))
    key = lambda r: (r.order_id, tuple(r.group))
    assert sorted(map(key, a[2].collect())) == sorted(map(key, b[2].collect()))


def test_hot_basket_detected_from_sample_and_split(spark):
    from pyspark.sql import functions as F

    from basketry.operators.baskets import basket_items
    from basketry.operators.pairs import hot_baskets

    hot = spark.range(3000).select(F.lit(-1).cast("bigint").alias("order_id"),
                                   F.col("id").alias("item"))
    normal = spark.range(2000).select((F.col("id") % 400).alias("order_id"),
                                      (F.col("id") % 37).alias("item"))
    lines = hot.unionByName(normal)
    flagged = hot_baskets(basket_items(lines), block_size=256, sample_fraction=0.05).collect()
    assert [r.order_id for r in flagged] == [-1] and flagged[0]._nb >= 2
    pairs = self_join_pair_occurrences(lines, block_size=256, sample_fraction=0.05)
    got = pairs.groupBy((F.col("order_id") == -1).alias("hot")).agg(F.sum("n").alias("n"))
    got = {r.hot: r.n for r in got.collect()}
    assert got[True] == 3000 * 2999 // 2
    assert got[False] == pair_count(normal).first().pair_count


def test_third_of_all_lines_in_one_basket(spark):
    """One order holds a third of the sf0.001 lines: detected, blocked, results exact."""
    from pyspark.sql import functions as F

    from basketry.sources.tables import order_lines_from_dir
    from tests.conftest import SF_SMALL

    base = order_lines_from_dir(spark, SF_SMALL)
    skewed = base.select(F.when(F.pmod(F.xxhash64("order_id", "item"), F.lit(3)) == 0,
                                F.lit(-7)).otherwise(F.col("order_id")).cast("bigint")
                         .alias("order_id"), "item")
    hot_lines = skewed.where("order_id = -7").count()
    assert hot_lines > 1500
    expect = pair_count(skewed).first().pair_count
    pairs = self_join_pair_occurrences(skewed, block_size=32, sample_fraction=0.1)
    assert pairs.agg(F.sum("n")).first()[0] == expect
    total = frequent_pairs(skewed, 0, block_size=32).agg(F.sum("support")).first()[0]
    assert total == expect
    assert pcy_candidates(skewed, 0, item_mod=None, block_size=32).count() == expect


def test_bucket_prefilter_auto(spark):
    baskets = _random_baskets(18, max_item=12)
    lines = lines_df(spark, baskets)
    n_pairs = sum(len(brute.groups(b, 2)) for b in baskets.values())
    # few pairs per bucket: the filter pays; more pairs than buckets x (s + 1): it does not
    assert bucket_prefilter_pays(lines, 1)
    assert not bucket_prefilter_pays(lines, 1, num_buckets=n_pairs // 2)
    expect = brute.frequent_pairs(baskets, 1)
    for mode in ("auto", True, False):
        got = sorted(map(tuple, frequent_pairs(lines, 1, bucket_prefilter=mode).collect()))
        assert got == expect
    got = sorted(map(tuple, frequent_pairs(lines, 1, bucket_prefilter="auto",
                                           num_buckets=7).collect()))
    assert got == expect
    with pytest.raises(ValueError):
        frequent_pairs(lines, 1, bucket_prefilter="yes")
