"""Stored filters and basket items with a layout that later runs join without moving them.

A store folder holds:

* ``items``: frequent items ``(item, support)``, bucketed and sorted by item;
* ``baskets``: basket items ``(order_id, item, mult)``, bucketed and sorted by item alike;
* ``bitmap``: the frequent pair buckets as a bitmap table (125 KB for 999,917 buckets).

Bucketing is a property of a catalog table, so a store is opened under names derived from its path; another
session opens the same files again. ``close_store`` forgets the names and leaves the files.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.bitmaps import bitmap_table
from basketry.functions.hashes import PAIR_BUCKETS
from basketry.operators.baskets import shared_items
from basketry.operators.counting import (frequent_buckets, having_support, shared_item_counts)
from basketry.operators.pairs import DEFAULT_BLOCK_SIZE, pair_occurrences
from basketry.sinks.tables import open_bucketed, write_bucketed

BUCKETED = ("items", "baskets")


@dataclass(frozen=True)
class Store:
    items: DataFrame
    baskets: DataFrame
    bitmap: DataFrame
    num_buckets: int


def table_name(path: str, part: str) -> str:
    return f"basketry_{part}_{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:16]}"


def save_store(lines: DataFrame, support: int, path: str, buckets: int = 64,
               num_buckets: int = PAIR_BUCKETS, block_size: int | None = DEFAULT_BLOCK_SIZE,
               hash_fn=None, bucket_support: int | None = None) -> str:
    """Count ``lines`` and write both filters and the basket items below ``path``.

    ``buckets`` is the number of files a table is laid out in: about its size / 200 MB. ``hash_fn(a, b)``
    replaces the pair hash (with ``num_buckets`` its range), ``bucket_support`` the buckets' support.
    """
    baskets = shared_items(lines)
    write_bucketed(having_support(shared_item_counts(baskets), support), f"{path}/items", table_name(path, "items"),
                   "item", buckets)
    write_bucketed(baskets.select("order_id", "item", "mult"), f"{path}/baskets", table_name(path, "baskets"), "item", buckets)
    pairs = pair_occurrences(baskets, block_size)
    if hash_fn is not None:
        pairs = pairs.withColumn("bucket", hash_fn("item1", "item2"))
    many = frequent_buckets(pairs, support if bucket_support is None else bucket_support, num_buckets)
    bitmap_table(many).coalesce(1).write.mode("overwrite").parquet(f"{path}/bitmap")
    return path


def open_store(spark: SparkSession, path: str, buckets: int = 64, num_buckets: int = PAIR_BUCKETS,
               item_type: str = "bigint", order_type: str = "bigint") -> Store:
    """A store that this or an earlier session wrote."""
    schemas = {"items": f"item {item_type}, support bigint", "baskets": f"order_id {order_type}, item {item_type}, mult bigint"}
    tables = {p: open_bucketed(spark, f"{path}/{p}", table_name(path, p), schemas[p], "item", buckets) for p in BUCKETED}
    return Store(**tables, bitmap=spark.read.parquet(f"{path}/bitmap"), num_buckets=num_buckets)


def close_store(spark: SparkSession, path: str) -> None:
    """Forget the store's table names; the files stay."""
    for part in BUCKETED:
        spark.sql(f"DROP TABLE IF EXISTS {table_name(path, part)}")


def frequent_lines(store: Store) -> DataFrame:
    """``(order_id, item, mult)`` of the frequent items: both stored sides are read bucket by bucket and
    joined where they lie, without an exchange."""
    return store.baskets.join(store.items.select("item").hint("merge"), "item", "left_semi").select(
        "order_id", F.col("item"), "mult")
