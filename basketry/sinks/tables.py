"""Keyed table sinks: frequent items (K4), bucket bitmap (K5), any keyed table.

Each run overwrites its output, so no keys of an earlier run survive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def save_table(df: DataFrame, path: str, keys: Sequence[str] | None = None,
               partition_by: Sequence[str] | None = None) -> str:
    """Write ``df`` as parquet, one row per key (``keys``) when given."""
    if keys:
        df = df.dropDuplicates(list(keys))
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def save_frequent_items(items: DataFrame, path: str) -> str:
    """K4: ``(item, support)`` keyed by item. Items come from a groupBy, so unique."""
    return save_table(items.select("item", "support"), path)


def save_bitmap(buckets: DataFrame, path: str) -> str:
    """K5: frequent buckets ``(bucket, support)`` keyed by bucket (unique by construction)."""
    return save_table(buckets.select("bucket", "support"), path)


def write_bucketed(df: DataFrame, path: str, name: str, key: str, n: int, bloom: bool = False) -> None:
    """``df`` as a table ``name`` at ``path``, in ``n`` buckets by ``key``, one sorted file each."""
    writer = df.repartition(n, key).write.mode("overwrite").option("path", path)
    if bloom:  # each file tells which keys it can't hold
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.bucketBy(n, key).sortBy(key).saveAsTable(name)


def open_bucketed(spark: SparkSession, path: str, name: str, schema: str, key: str, n: int) -> DataFrame:
    """The table at ``path`` under its name, registered if this session's catalog doesn't know it."""
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
                  f"INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(name)
