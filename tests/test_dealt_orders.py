"""The join of the order tables, and responses, in tasks that don't grow with the tables."""

import pytest
from pyspark.sql import functions as F

from basketry import session
from basketry.plans import recommend
from basketry.sources.tables import order_lines

from .test_dealt import rows_of, tasks


@pytest.fixture
def tables(spark):
    n = 900
    orders = spark.range(n).select(F.when(F.col("id") != 5, F.col("id")).alias("o_orderkey")).union(
        spark.sql("SELECT 9L"))
    line = spark.range(3 * n).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") != 4, F.col("id") % n).cast("bigint").alias("l_orderkey"),
        F.when(F.col("id") % 3 == 1, 5).when(F.col("id") != 3, F.col("id") % 90).cast("bigint").alias("l_partkey"),
        F.col("id").alias("l_linenumber"))
    part = spark.range(80).withColumnRenamed("id", "p_partkey").union(spark.sql("SELECT 8L"))
    return orders, line, part


@pytest.mark.parametrize("row_id", [True, False])
def test_order_lines_are_dealt_and_no_table_is_broadcast(spark, tables, row_id, monkeypatch):
    orders, line, part = tables
    line = line if row_id else line.drop("l_linenumber")
    plain = rows_of(order_lines(orders, line, part))
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    few, many = order_lines(orders, line.where("l_linenumber < 900") if row_id else line.limit(900), part), order_lines(
        orders, line, part)
    assert tasks(many) >= 1.8 * tasks(few) > spark.sparkContext.defaultParallelism
    assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
    assert rows_of(many) == plain


def test_a_heavy_order_is_dealt_over_many_tasks(spark, tables, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    lines = order_lines(*tables)
    for key, value in (("order_id", 7), ("item", 5)):
        assert lines.where(F.col(key) == value).select(F.spark_partition_id()).distinct().count() > 4


def test_lookup_and_catalog_joins_of_responses_are_apart(spark, monkeypatch):
    kept, write = {}, recommend.materialized

    def noted(df, name):
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(recommend, "materialized", noted)
    requests = spark.createDataFrame([(1,), (1,), (9,), (None,)], "product_id long")
    recs = spark.createDataFrame([(1, 2, 5), (2, 3, 4), (1, 4, 3)], "product_id long, rec_id long, support long")
    cat = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "product_id long, description string, image string")
    out = recommend.respond(requests, recs, cat)
    one = '[{"description":"a","image":"x"},{"description":"b","image":null}]'
    assert sorted(out.collect(), key=str) == sorted([(1, one), (1, one), (9, ""), (None, "")], key=str)
    assert sorted(kept) == ["partner-lists", "partners", "requests"]
    assert "Window" not in out._jdf.queryExecution().analyzed().toString()
