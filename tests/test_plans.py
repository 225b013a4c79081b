"""Plan shape: each pair query joins the order tables once, with broadcasts off.

That is the plan large tables force: the items of each basket are written once, dealt out by order
and item, and every branch reads them.
"""

import re

import pytest

from basketry.operators import pairs as P
from basketry.operators.counting import frequent_pairs
from basketry.plans.pcy import filtered_by, pcy_candidates, pcy_pass
from basketry.session import ensure_checkpoint_dir, scratch_path
from basketry.sources.tables import order_lines_from_dir
from tests.conftest import SF_SMALL, lines_df

OFF = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture()
def no_broadcast(spark):
    for k, v in OFF.items():
        spark.conf.set(k, v)
    yield
    for k in OFF:
        spark.conf.unset(k)


@pytest.mark.parametrize("build", [
    lambda lines: frequent_pairs(lines, 1),
    lambda lines: frequent_pairs(lines, 1, bucket_prefilter=True),
    lambda lines: frequent_pairs(lines, 1, distinct_items=True),
    lambda lines: pcy_candidates(lines, 1, strategy="shuffle"),
    lambda lines: pcy_candidates(lines, 1, strategy="broadcast"),
    lambda lines: pcy_candidates(lines, 1),
    lambda lines: pcy_pass(lines, 2, 1)[1],
    lambda lines: pcy_pass(lines, 3, 1)[1],
], ids=["frequent", "frequent_prefilter", "frequent_distinct", "pcy_shuffle", "pcy_broadcast", "pcy_auto",
        "pass_2", "pass_3"])
def test_order_tables_are_joined_once(spark, no_broadcast, monkeypatch, build):
    made = []
    write = P.shared_items.__globals__["materialized"]

    def counted(df, name):
        made.append((name, df))
        return write(df, name)

    for module in (P, __import__("basketry.operators.baskets", fromlist=["x"]),
                   __import__("basketry.operators.membership", fromlist=["x"])):
        monkeypatch.setattr(module, "materialized", counted)
    out = build(order_lines_from_dir(spark, SF_SMALL))
    plans = [df._jdf.queryExecution().executedPlan().toString() for _, df in [*made, ("", out)]]
    assert sum(len(re.findall(r"Scan parquet .*l_partkey", p.split("Initial Plan")[-1])) for p in plans) == 1
    assert [n for n, _ in made].count("basket-items") == 1
    items = next(df for n, df in made if n == "basket-items")
    assert re.search(r"hashpartitioning\(order_id#\d+L?, item#\d+L?, \d+\), REPARTITION_BY_COL",
                     items._jdf.queryExecution().executedPlan().toString())


def test_item_ids_above_the_modulus(spark):
    big = 200_000_000
    lines = lines_df(spark, {k: [big + 1, big + 2, 1] for k in range(5)} | {9: [100_000_001, 7]})
    want = {(1, big + 1): 5, (1, big + 2): 5, (big + 1, big + 2): 5}
    got = [(r.item1, r.item2) for r in pcy_candidates(lines, 1).collect()]
    assert {p: got.count(p) for p in got} == want
    assert pcy_candidates(lines, 1, item_mod=100_000_000).count() == 0  # the reference's rule drops them


def test_filters_from_saved_tables(spark):
    lines = lines_df(spark, {k: [1, 2, 3 + k] for k in range(4)})
    items = spark.createDataFrame([(1, 4), (2, 4)], "item BIGINT, support BIGINT")
    buckets = spark.createDataFrame([(3 * 5 % 999917, 4)], "bucket BIGINT, support BIGINT")
    assert {tuple(r) for r in filtered_by(lines, items, buckets).select("item1", "item2", "n").collect()} == {(1, 2, 1)}


def test_expansion_is_bounded(spark):
    n = 5 * 2**31 + 3
    df = spark.createDataFrame([(1, 2, 3, n), (2, 2, 3, 0), (3, 4, 5, 1)], "order_id BIGINT, item1 BIGINT, item2 BIGINT, n BIGINT")
    steps = P.occurrence_steps(df, ("order_id", "item1", "item2"))
    got = {r.order_id: (r.s, r.m) for r in steps.groupBy("order_id").agg({"_step": "sum"}).withColumnRenamed(
        "sum(_step)", "s").join(steps.groupBy("order_id").agg({"_step": "max"}).withColumnRenamed("max(_step)", "m"), "order_id").collect()}
    assert got == {1: (n, P.EXPAND_STEP), 3: (1, 1)}
    assert P.expand_occurrences(df.filter("n < 10").unionAll(df.limit(1).selectExpr("7", "8", "9", "200000L"))).count() == 200_001


class _Remote:
    """Just what ``ensure_checkpoint_dir`` asks of a cluster session without a shared folder."""

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class conf:
        get = staticmethod(lambda key, default=None: default)


def test_a_cluster_needs_a_shared_folder(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Remote())
    assert "basketry-scratch" in scratch_path(spark, "x")
