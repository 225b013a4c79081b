"""Steps whose sorts and hash tables would grow with the rows run in tasks whose number grows with them."""

import random

import pytest
from pyspark.sql import functions as F

from basketry import session
from basketry.operators.baskets import basket_items, csv_order_runs, shared_items
from basketry.operators.counting import frequent_pairs
from basketry.operators.membership import STRATEGIES, side_strategy
from basketry.operators.pairs import pair_occurrences
from basketry.plans.pcy import pcy_distinct_pairs, pcy_pass


@pytest.fixture
def lines(spark):
    rng = random.Random(3)
    rows = [(o, rng.randrange(80)) for o in range(300) for _ in range(rng.randrange(1, 7))] + [(None, 1), (7, 7), (7, 7)]
    return spark.createDataFrame(rows, "order_id long, item long").dropna()


def tasks(df):
    return df.rdd.getNumPartitions()


def rows_of(df):
    return sorted(map(tuple, df.collect()))


STEPS = {
    "frequent_pairs": lambda x: frequent_pairs(x, 1),
    "frequent_pairs_distinct": lambda x: frequent_pairs(x, 1, distinct_items=True),
    "frequent_pairs_arrays": lambda x: frequent_pairs(
        x.groupBy("order_id").agg(F.sort_array(F.collect_list("item")).alias("items")), 1),
    "distinct_keys": lambda x: pcy_distinct_pairs(x, 1),
    "pcy_pass_frequent": lambda x: pcy_pass(x, 2, 1)[0],
    "basket_items": basket_items,
    "pairs": lambda x: pair_occurrences(shared_items(x)),
    "csv_basket_runs": lambda x: csv_order_runs(x.select(
        "order_id", "item", F.lit("f").alias("_file"), F.floor(F.col("order_id") / 10).alias("_block"),
        (F.col("order_id") * 1000 + F.col("item")).alias("_row"))).select("key", "n_items", "items"),
}


@pytest.mark.parametrize("name", STEPS)
def test_tasks_grow_with_the_rows(spark, lines, name, monkeypatch):
    plain = rows_of(STEPS[name](lines))
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    few, many = STEPS[name](lines.where("order_id < 100")), STEPS[name](lines)
    assert tasks(many) >= 1.8 * tasks(few) > spark.sparkContext.defaultParallelism
    assert rows_of(many) == plain


def test_few_items_are_grouped_before_they_are_sent(lines, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    few = lines.withColumn("item", F.col("item") % 6)
    plan = frequent_pairs(few, 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "partial_sum" in plan.split("Exchange", 1)[1]


def test_many_rows_are_not_sorted_to_meet_the_frequent_items(spark, lines, monkeypatch):
    rows = shared_items(lines)
    assert side_strategy("auto", rows) == "auto"
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    assert [side_strategy(s, rows) for s in STRATEGIES] == ["shuffle", "broadcast", "shuffle"]
