"""Frequent itemsets with Spark's parallel FP-growth.

FP-growth shuffles each transaction's conditional suffixes to item-keyed
partitions and grows local trees there; it is Spark's own distributed
implementation, so nothing is reimplemented here. Its threshold is
``freq >= ceil(min_support * n_transactions)`` (not strict, unlike PCY).
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transaction_sets(lines: DataFrame, key: str = "order_id", item: str = "item") -> DataFrame:
    """Distinct items per transaction, ``items array``.

    ``collect_set`` is merged map-side, so the state per basket is bounded by
    its number of distinct items.
    """
    return lines.groupBy(key).agg(F.collect_set(item).alias("items"))


def fp_growth(transactions: DataFrame, min_support: float = 0.3,
              num_partitions: int | None = None, items_col: str = "items") -> DataFrame:
    """All itemsets with support >= ``min_support``: ``(items array, freq)``.

    Repeated items in a transaction are removed first (FP-growth rejects them).
    ``num_partitions=None`` uses the input's partitioning.
    """
    data = transactions.select(F.array_distinct(F.col(items_col)).alias("items"))
    fpg = FPGrowth(itemsCol="items", minSupport=min_support)
    if num_partitions:
        fpg = fpg.setNumPartitions(num_partitions)
    model = fpg.fit(data)
    return model.freqItemsets.select("items", F.col("freq").cast("bigint").alias("freq"))

