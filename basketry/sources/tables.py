"""S1 table scans and J1/P1 order lines from the order tables."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import dealt, tasks_of

DEFAULT_TABLES = ("orders", "lineitem", "part")


def load_tables(spark: SparkSession, base_dir: str,
                names: Iterable[str] = DEFAULT_TABLES,
                register: bool = True) -> dict[str, DataFrame]:
    """Read ``<base_dir>/<name>.parquet`` for each name, optionally as temp views.

    Scans are lazy; later projections and filters prune columns and push
    predicates into each parquet scan. Split size is the session's
    ``spark.sql.files.maxPartitionBytes``.
    """
    tables = {}
    for name in names:
        df = spark.read.parquet(os.path.join(base_dir, f"{name}.parquet"))
        if register:
            df.createOrReplaceTempView(name)
        tables[name] = df
    return tables


def order_lines(orders: DataFrame, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """J1 + P1: orders ⋈ lineitem ⋈ part, projected to ``(order_id, item)``.

    One row per order line; an item ordered twice in one order gives two rows.
    Only the two key columns are read from the scans, and lines without a key
    are dropped before any shuffle. Tables of at most ``TASK_ROWS`` rows are left
    to the planner and AQE. Larger ones (their rows are counted first) are
    dealt out by key over tasks whose number grows with the rows and sort-merge
    joined: a broadcast picked from file sizes is a hash table of all orders in
    each executor. Keys that hold a task's rows or more are salted.
    """
    o = orders.select(F.col("o_orderkey").alias("order_id"))
    p = part.select(F.col("p_partkey").alias("item"))
    rows = max(t.count() for t in (orders, lineitem, part))
    tasks = tasks_of(lineitem.sparkSession, rows)
    cols = {"order_id": "l_orderkey", "item": "l_partkey"}
    if not tasks:
        li = lineitem.select(*[F.col(c).alias(k) for k, c in cols.items()]).dropna()
        return li.join(p, "item").join(o, "order_id").select("order_id", "item")
    if ROW_ID in lineitem.columns:
        cols["_row"] = ROW_ID
    li = lineitem.select(*[F.col(c).alias(k) for k, c in cols.items()]).dropna(subset=["order_id", "item"])
    heavy = min(max(tasks[0], HEAVY), MOST_HEAVY)
    joined = salted_join(li, p, "item", heavy_keys(li, "item", heavy), tasks[0], rows)
    return salted_join(joined, o, "order_id", heavy_keys(li, "order_id", heavy), tasks[0], rows).select("order_id", "item")


#: Keys with at least this share (1 / HEAVY) of all lines are spread; at most so many exist.
HEAVY = 64
#: Large tables: keys with at least a task's rows are spread, but no more of them than this.
MOST_HEAVY = 4096
#: Tells apart lines of the same order and item.
ROW_ID = "l_linenumber"


def heavy_keys(lines: DataFrame, key: str, heavy: int = HEAVY) -> list:
    """Keys with about 1 / ``heavy`` of the rows of ``lines`` or more, by a sketch of bounded size.

    Every task keeps a top-items sketch, and Spark merges them; nothing is shuffled but sketches. The
    list only decides how rows are dealt out, so an estimate is enough.
    """
    top = lines.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k({key}, {2 * heavy}, {64 * heavy})").alias("t")).first()
    return [x["item"] for x in top["t"] or () if x["count"] * heavy >= top["n"] and x["item"] is not None]


def salted_join(lines: DataFrame, side: DataFrame, key: str, hot: list, salts: int, rows: int = 0) -> DataFrame:
    """``lines`` joined with ``side`` on ``key``; lines of ``hot`` keys are dealt over ``salts`` keys by a hash of
    the row, and only the hot keys' rows of ``side`` are repeated for each. ``rows``, if given, is how many
    the larger one has: many are dealt out over tasks that grow with them and sort-merge joined."""
    keys = [key]
    if hot:
        salt = F.pmod(F.xxhash64(*lines.columns), F.lit(salts)).cast("int")
        lines = lines.withColumn("_salt", F.when(F.col(key).isin(hot), salt).otherwise(F.lit(0)))
        copies = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        side, keys = side.withColumn("_salt", F.explode(copies)), [key, "_salt"]
    if tasks_of(lines.sparkSession, rows):
        lines, side = dealt(lines, rows, *keys), dealt(side, rows, *keys).hint("merge")
    return lines.join(side, keys).drop("_salt")


def order_lines_salted(orders: DataFrame, lineitem: DataFrame, part: DataFrame, salts: int = 32,
                       heavy: int = HEAVY, row_id: str = ROW_ID) -> DataFrame:
    """J1 + P1 for skewed keys: the rows of ``order_lines``, with heavy orders and items spread over tasks.

    Heavy keys are found by a sketch over the two key columns (one more scan of them). ``row_id`` tells
    apart lines of the same order and item, so that they are dealt out too. This doesn't depend on
    adaptive execution or broadcasts.
    """
    o = orders.select(F.col("o_orderkey").alias("order_id"))
    li = lineitem.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("item"),
                         F.col(row_id).alias("_row")).dropna(subset=["order_id", "item"])
    p = part.select(F.col("p_partkey").alias("item"))
    joined = salted_join(li, p, "item", heavy_keys(li, "item", heavy), salts)
    return salted_join(joined, o, "order_id", heavy_keys(li, "order_id", heavy), salts).select("order_id", "item")


def order_lines_from_dir(spark: SparkSession, base_dir: str) -> DataFrame:
    t = load_tables(spark, base_dir, DEFAULT_TABLES, register=False)
    return order_lines(t["orders"], t["lineitem"], t["part"])


def order_lines_sql(spark: SparkSession, base_dir: str) -> DataFrame:
    """J1 as the reference states it: one SQL statement over registered views."""
    load_tables(spark, base_dir, DEFAULT_TABLES, register=True)
    return spark.sql(
        "SELECT o.o_orderkey AS order_id, p.p_partkey AS item "
        "FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey "
        "JOIN part p ON l.l_partkey = p.p_partkey")


def key_to_string(lines: DataFrame, cols: Iterable[str] = ("order_id", "item")) -> DataFrame:
    """Both keys as strings, as the text basket builder emits them."""
    return lines.select(*[F.col(c).cast("string").alias(c) for c in cols])


def catalog_from_part(part: DataFrame) -> DataFrame:
    """Stand-in product catalog: ``(product_id, description, image)``."""
    return part.select(F.col("p_partkey").alias("product_id"),
                       F.col("p_name").alias("description"),
                       F.col("p_brand").alias("image"))
