"""Bitmaps, stored layouts, incremental merge, the tree scan of runs and joins with heavy keys."""

import os
import random

import pytest
from pyspark.sql import functions as F

from basketry.functions import bitmaps
from basketry.operators import baskets as B
from basketry.operators import recommend as R
from basketry.plans.pcy import pcy_candidates, pcy_candidates_bitmap, pcy_candidates_from_store
from basketry.plans.probe import probe_hits, probe_store
from basketry.session import scratch_path
from basketry.sinks.store import close_store, frequent_lines, open_store, save_store
from basketry.sources.tables import heavy_keys, order_lines, order_lines_salted
from tests import brute
from tests.conftest import arrays_df, lines_df

QUIET = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
         "spark.sql.adaptive.skewJoin.enabled": "false"}


@pytest.fixture()
def plain_joins(spark):
    for k, v in QUIET.items():
        spark.conf.set(k, v)
    yield
    for k in QUIET:
        spark.conf.unset(k)
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _baskets(seed, n=80):
    rnd = random.Random(seed)
    return {i: [rnd.randrange(25) for _ in range(rnd.randrange(9))] for i in range(n)}


# ---------------------------------------------------------------- bitmap
def test_bitmap_holds_exactly_its_buckets(spark):
    size = 100_003
    rnd = random.Random(1)
    some = {0, 1, 7, 8, 63, 64, 32767, 32768, 65535, size - 1} | {rnd.randrange(size) for _ in range(300)}
    rows = spark.createDataFrame([(b,) for b in sorted(some)], "bucket BIGINT").repartition(3)
    table = bitmaps.bitmap_table(rows)
    assert table.count() <= -(-size // bitmaps.PIECE_BITS)
    words = bitmaps.bitmap_words(table, size)
    every = spark.range(size).select(F.col("id").alias("bucket"))
    assert {r.bucket for r in every.where(bitmaps.in_bitmap(words, F.col("bucket"))).collect()} == some
    none = bitmaps.bitmap_words(bitmaps.bitmap_table(rows.where("bucket < 0")), size)
    assert every.where(bitmaps.in_bitmap(none, F.col("bucket"))).count() == 0


def test_bitmaps_of_several_runs_merge(spark):
    a, b = (bitmaps.bitmap_table(spark.createDataFrame([(x,) for x in xs], "bucket BIGINT"))
            for xs in ([1, 5, 40_000], [5, 9, 70_000]))
    words = bitmaps.bitmap_words(bitmaps.merge_bitmaps(a, b), 99_999)
    got = spark.range(99_999).withColumnRenamed("id", "bucket").where(bitmaps.in_bitmap(words, F.col("bucket")))
    assert {r.bucket for r in got.collect()} == {1, 5, 9, 40_000, 70_000}


@pytest.mark.parametrize("support", [0, 1, 3])
def test_bitmap_candidates_equal_the_joined_ones(spark, support):
    baskets = _baskets(support)
    want = brute.pcy_rows(baskets, support, 97, None)
    for df in (lines_df(spark, baskets), arrays_df(spark, baskets)):
        out = pcy_candidates_bitmap(df, support, num_buckets=97)
        assert sorted(tuple(r) for r in out.collect()) == want
        assert "bucket" not in "".join(x for x in _plan(out).split("\n") if "Join" in x)  # no join on the bucket


# ---------------------------------------------------------------- store
def test_store_is_joined_in_place(spark, plain_joins):
    baskets = _baskets(5)
    path = save_store(lines_df(spark, baskets), 2, scratch_path(spark, "store"), buckets=4)
    close_store(spark, path)
    store = open_store(spark, path, buckets=4)  # as a later session does
    kept = frequent_lines(store)
    plan = _plan(kept)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sorted(tuple(r) for r in pcy_candidates_from_store(store).collect()) == sorted(
        tuple(r) for r in pcy_candidates(lines_df(spark, baskets), 2).collect())
    close_store(spark, path)
    assert not [t for t in spark.catalog.listTables() if t.name.endswith(path[-8:])]


def test_probe_of_a_store(spark, plain_joins):
    lines = lines_df(spark, _baskets(6, 300))
    path = save_store(lines, 5, scratch_path(spark, "probe"), buckets=4, num_buckets=1000,
                      hash_fn=lambda a, b: F.pmod(F.col(a) * F.col(b), F.lit(1000)), bucket_support=3)
    store = open_store(spark, path, 4, 1000)
    buckets = (spark.range(1000).withColumnRenamed("id", "bucket")
               .where(bitmaps.in_bitmap(bitmaps.bitmap_words(store.bitmap, 1000), F.col("bucket"))))
    want = probe_hits(spark, store.items, buckets, 30, a=7).first()
    out = probe_store(store, 30, a=7)
    got = out.first()
    assert (got.probes, got.hits) == (want.probes, want.hits) and got.hits > 0
    assert got.hit_rate == got.hits / 30
    stored = [x for x in _plan(out).split("\n") if "Scan parquet" in x]
    assert stored and all("Bucketed: true" in x or "bits" in x for x in stored)


def test_stored_partners_prune_by_either_column(spark):
    recs = spark.range(20_000).select(F.col("id").alias("product_id"), (F.col("id") + 50_000).alias("rec_id"),
                                      F.lit(3).cast("bigint").alias("support"))
    path = scratch_path(spark, "partners")
    name = R.save_partners(recs, path, "test_partners_" + path[-8:], buckets=8)
    asked = spark.createDataFrame([(17,), (50_018,), (17,), (-4,), (None,)], "product_id BIGINT")
    out = R.lookup_stored(spark, name, asked)
    assert sorted(tuple(r) for r in out.collect()) == [(17, 50_017), (50_018, 18)]
    assert "SelectedBucketsCount: " in _plan(out) and "SelectedBucketsCount: 8 " not in _plan(out)
    assert R.lookup_stored(spark, name, asked, max_listed=1).count() == 2  # joined bucket by bucket
    spark.sql(f"DROP TABLE {name}")


def test_merge_rewrites_touched_folders_only(spark):
    path = scratch_path(spark, "recs")
    recs = spark.range(200).select(F.col("id").alias("product_id"), F.lit(5).cast("bigint").alias("rec_id"),
                                   F.lit(2).cast("bigint").alias("support"))

    def files():
        root = path.removeprefix("file:")
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
                for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}

    R.merge_recommendations(recs, path, parts=16)
    before = files()
    new = spark.createDataFrame([(3, 9, 1), (3, 8, 1), (1000, 4, 7)], "product_id BIGINT, rec_id BIGINT, support BIGINT")
    R.merge_recommendations(new, path, parts=16)
    stay = {f for f, t in files().items() if before.get(f) == t}
    assert len(stay) >= 14 and len(before) - len(stay) in (1, 2)
    got = {r.product_id: (r.rec_id, r.support) for r in spark.read.parquet(path).collect()}
    assert got == {**{i: (5, 2) for i in range(200)}, 3: (8, 1), 1000: (4, 7)}
    R.merge_recommendations(new.limit(0), path, parts=16)
    assert spark.read.parquet(path).count() == 201


# ---------------------------------------------------------------- runs
@pytest.mark.parametrize("parts,fan", [(1, 256), (8, 256), (7, 2), (30, 2)])
def test_runs_by_a_tree_of_summaries(spark, monkeypatch, parts, fan):
    rnd = random.Random(parts)
    keys = [k for _ in range(60) for k in [rnd.choice([1, 2, None])] * rnd.choice([1, 1, 2, 7, 40])]
    rows = spark.createDataFrame([(i, k, i) for i, k in enumerate(keys)], "id BIGINT, k BIGINT, item BIGINT").repartition(4)
    monkeypatch.setattr(B, "FAN", fan)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        out = B.basket_run_rows(rows, "k", "item", ["id"], [F.floor(F.col("id") / 5)])
        assert "Exchange SinglePartition" not in _plan(out)
        got = sorted((r.id, r.key, r.run_start, r.n_items) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want, start = [], 0
    for i, k in enumerate(keys):
        if i and keys[i - 1] != k:
            start = i
        want.append([i, k, start])
    sizes = {s: sum(w[2] == s for w in want) for _, _, s in want}
    assert got == [(i, k, s, sizes[s]) for i, k, s in want]


# ---------------------------------------------------------------- heavy keys
def test_heavy_orders_and_items_are_spread(spark, plain_joins):
    n = 6000
    line = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("bigint").alias("l_orderkey"),
        F.when(F.col("id") % 3 == 1, 5).otherwise(F.col("id") % 900).cast("bigint").alias("l_partkey"),
        F.col("id").alias("l_linenumber"))
    orders = spark.range(n).withColumnRenamed("id", "o_orderkey")
    part = spark.range(800).withColumnRenamed("id", "p_partkey")
    keys = line.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("item"))
    assert heavy_keys(keys, "order_id") == [7] and heavy_keys(keys, "item") == [5]
    assert heavy_keys(keys.limit(0), "item") == []
    out = order_lines_salted(orders, line, part, salts=16)
    assert out.exceptAll(order_lines(orders, line, part)).count() == 0 and out.count() == order_lines(orders, line, part).count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        def tasks(df, key, value):
            return df.where(F.col(key) == value).select(F.spark_partition_id()).distinct().count()

        assert tasks(order_lines_salted(orders, line, part, salts=16), "order_id", 7) >= 5
        assert tasks(order_lines(orders, line, part), "order_id", 7) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
