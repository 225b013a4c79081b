import random

import pytest
from pyspark.sql import functions as F

from basketry.functions.groups import group_count, item_groups, item_pairs
from basketry.functions.hashes import (hash_group, hash_pair, hash_pair_25, hash_pair_1000,
                                       hash_single, hash_single_group)
from tests.brute import groups, pair_hash, single_hash


def _groups(spark, basket, k):
    df = spark.createDataFrame([(basket,)], "items ARRAY<BIGINT>")
    row = df.select(item_groups("items", k).alias("g"), group_count(F.size("items"), k)
                    .alias("n")).first()
    return [tuple(g) for g in row.g], row.n


def test_docstring_example_k3(spark):
    got, n = _groups(spark, [2, 3, 4, 5], 3)
    assert got == [(2, 3, 4), (2, 3, 5), (3, 4, 5)]
    assert n == 3


def test_k1_keeps_input_order_and_duplicates(spark):
    got, _ = _groups(spark, [5, 1, 5], 1)
    assert got == [(5,), (1,), (5,)]


def test_k2_self_pair_from_duplicates(spark):
    got, n = _groups(spark, [5, 3, 5], 2)
    assert got == [(3, 5), (3, 5), (5, 5)]
    assert n == 3


def test_k_larger_than_basket_is_empty(spark):
    assert _groups(spark, [1, 2], 3)[0] == []
    assert _groups(spark, [], 2)[0] == []
    assert _groups(spark, [7], 2)[0] == []


@pytest.mark.parametrize("k", [0, -1, 1.5, True, "2"])
def test_bad_group_size_raises(k):
    with pytest.raises(ValueError):
        item_groups(F.col("items"), k)


def test_groups_match_python_on_random_baskets(spark):
    rng = random.Random(3)
    baskets = [[rng.randrange(0, 12) for _ in range(rng.randrange(0, 9))] for _ in range(40)]
    df = spark.createDataFrame([(b,) for b in baskets], "items ARRAY<BIGINT>")
    for k in (1, 2, 3, 4):
        rows = df.select(item_groups("items", k).alias("g"),
                         group_count(F.size("items"), k).alias("n")).collect()
        for b, r in zip(baskets, rows):
            assert [tuple(g) for g in r.g] == groups(b, k)
            assert r.n == len(groups(b, k))
    pairs = df.select(item_pairs("items").alias("p")).collect()
    for b, r in zip(baskets, pairs):
        assert [(p.item1, p.item2) for p in r.p] == groups(b, 2)


def test_hashes_match_exact_products(spark):
    rng = random.Random(5)
    vals = [0, 1, 2, 999916, 999917, 99999999, 100000000, 123456789012]
    vals += [rng.randrange(0, 10**12) for _ in range(30)]
    rows = [(a, b) for a in vals[:12] for b in vals[-12:]]
    df = spark.createDataFrame(rows, "a BIGINT, b BIGINT")
    out = df.select("a", "b", hash_pair("a", "b").alias("h2"), hash_pair_25("a", "b").alias("h3"),
                    hash_pair_1000("a", "b").alias("h4"), hash_single("a").alias("h1"),
                    hash_group(F.array("a", "b")).alias("hg"),
                    hash_single_group(F.array("a", "b")).alias("h1g")).collect()
    for r in out:
        assert r.h2 == pair_hash((r.a, r.b)) == r.hg
        assert r.h3 == (r.a * r.b) % 25
        assert r.h4 == (r.a * r.b) % 1000
        assert r.h1 == r.a % 100000000
        assert r.h1g == single_hash((r.a, r.b))


def test_hash_of_empty_group_is_one(spark):
    df = spark.createDataFrame([([],)], "items ARRAY<BIGINT>")
    r = df.select(hash_single_group("items").alias("a"), hash_group("items").alias("b")).first()
    assert (r.a, r.b) == (1, 1)
