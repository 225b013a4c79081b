import os

import pytest
from pyspark.errors import PySparkException

from basketry.operators.baskets import build_baskets
from basketry.sinks.tables import save_bitmap, save_frequent_items, save_table
from basketry.sinks.text import write_baskets, write_pairs_text
from basketry.sources.tables import load_tables, order_lines, order_lines_sql
from basketry.sources.text import read_baskets, read_order_csv, read_transactions
from tests.conftest import SF_SMALL, lines_df


def _write(path, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.txt"), "w") as f:
        f.write(text)
    return path


def test_parse_spaced_tight_empty_and_second_colon(spark, tmp_out):
    p = _write(tmp_out, "1 : 155190 67310\nA17:8031 440740\n7:\n9 : 4 5 : 6\n")
    rows = {r.order_id: list(r.items) for r in read_baskets(spark, p).collect()}
    assert rows == {"1": [155190, 67310], "A17": [8031, 440740], "7": [], "9": [4, 5]}


@pytest.mark.parametrize("bad", ["no colon here", "3 : 1  2", "4 : 1 x", "5 : 1.5"])
def test_failfast_rejects_malformed(spark, tmp_out, bad):
    p = _write(tmp_out, f"1 : 2 3\n{bad}\n")
    with pytest.raises(PySparkException):
        read_baskets(spark, p).collect()


def test_permissive_drops_bad_lines_and_tokens(spark, tmp_out):
    p = _write(tmp_out, "1 : 2 3\nno colon\n3 : 1  x 2\n")
    rows = {r.order_id: list(r.items) for r in read_baskets(spark, p, "permissive").collect()}
    assert rows == {"1": [2, 3], "3": [1, 2]}


def test_basket_text_round_trip(spark, tmp_out):
    lines = lines_df(spark, {1: [5, 3, 5], 2: [7], 100000001: [0, 2]})
    baskets = build_baskets(lines)
    for name, sep in (("spaced", " : "), ("tight", ":")):
        path = write_baskets(baskets, os.path.join(tmp_out, name), sep, n_files=1)
        back = read_baskets(spark, path, key_type="bigint")
        assert sorted((r.order_id, list(r.items)) for r in back.collect()) == \
            sorted((r.order_id, list(r.items)) for r in baskets.collect())
    text = sorted(r.value for r in spark.read.text(os.path.join(tmp_out, "spaced")).collect())
    assert text == ["1 : 3 5 5", "100000001 : 0 2", "2 : 7"]


def test_pairs_text_format(spark, tmp_out):
    df = spark.createDataFrame([(1, 2), (12661, 13417)], "item1 BIGINT, item2 BIGINT")
    path = write_pairs_text(df, os.path.join(tmp_out, "pairs"))
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["(1, 2)", "(12661, 13417)"]


def test_transactions_split_and_dedup(spark, tmp_out):
    p = _write(tmp_out, "a b a\n  c  \n")
    rows = [list(r.items) for r in read_transactions(spark, p).collect()]
    assert rows == [["a", "b"], ["c"]]


def test_order_csv_columns_and_file_order(spark, tmp_out):
    p = _write(tmp_out, "100,x,y,8031\n100,x,y,440740\n101,q,r,7\n")
    rows = read_order_csv(spark, p, with_order=True).orderBy("_file", "_block", "_row").collect()
    assert [(r.order_id, r.item) for r in rows] == [("100", "8031"), ("100", "440740"),
                                                     ("101", "7")]


def test_order_lines_sql_equals_dataframe(spark):
    t = load_tables(spark, SF_SMALL)
    a = order_lines(t["orders"], t["lineitem"], t["part"])
    b = order_lines_sql(spark, SF_SMALL)
    assert a.count() == 6000
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_order_lines_prune_columns(spark):
    t = load_tables(spark, SF_SMALL, register=False)
    plan = order_lines(t["orders"], t["lineitem"], t["part"])._jdf.queryExecution() \
        .executedPlan().toString()
    assert "l_extendedprice" not in plan and "p_name" not in plan


def test_keyed_sinks_overwrite_and_dedup(spark, tmp_out):
    items = spark.createDataFrame([(1, 5), (2, 6)], "item BIGINT, support BIGINT")
    path = save_frequent_items(items, os.path.join(tmp_out, "items"))
    save_frequent_items(items.where("item = 1"), path)
    assert [r.item for r in spark.read.parquet(path).collect()] == [1]
    buckets = spark.createDataFrame([(9, 2)], "bucket BIGINT, support BIGINT")
    assert spark.read.parquet(save_bitmap(buckets, os.path.join(tmp_out, "b"))).count() == 1
    dup = spark.createDataFrame([(1, 1), (1, 2)], "k BIGINT, v BIGINT")
    assert spark.read.parquet(save_table(dup, os.path.join(tmp_out, "d"), ["k"])).count() == 1
