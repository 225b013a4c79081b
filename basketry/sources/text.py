"""Text and CSV sources: basket lines (S2), transactions (S3), order CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.text import FAILFAST, PERMISSIVE, parse_basket, split_tokens


def read_baskets(spark: SparkSession, path: str, mode: str = FAILFAST,
                 key_type: str = "string", item_type: str = "bigint") -> DataFrame:
    """Basket lines ``key : i1 i2`` -> ``(order_id, items array)``.

    The key is kept (the reference parses it away). A line is one basket, so
    the scan splits across files and blocks with no shuffle.
    """
    parsed = spark.read.text(path).select(parse_basket("value", mode, item_type).alias("b"))
    if mode == PERMISSIVE:
        parsed = parsed.where(F.col("b").isNotNull())
    key = F.col("b.key")
    if key_type != "string":
        key = key.cast(key_type) if mode == FAILFAST else key.try_cast(key_type)
    return parsed.select(key.alias("order_id"), F.col("b.items").alias("items"))


def read_transactions(spark: SparkSession, path: str, sep: str = " ",
                      distinct: bool = True) -> DataFrame:
    """S3: one transaction per line, tokens split on ``sep`` -> ``items array<string>``.

    Repeated tokens are removed by default, since FP-growth rejects them.
    """
    return spark.read.text(path).select(split_tokens("value", sep, distinct).alias("items"))


def read_order_csv(spark: SparkSession, path: str, key_col: int = 0, item_col: int = 3,
                   header: bool = False, item_type: str = "string",
                   with_order: bool = False) -> DataFrame:
    """Order rows from CSV; column ``key_col`` is the order, ``item_col`` the item.

    Returns ``(order_id, item)`` as strings (item cast to ``item_type``). With
    ``with_order`` the columns ``_file, _block, _row`` give the file order of
    each row (file path, split start, row position inside the split), which the
    consecutive-run builder needs; the ids are assigned in the scan stage, so
    a recomputed split gets the same ones. Files are ordered by path text.
    """
    cols = [f"c{i}" for i in range(max(key_col, item_col) + 1)]
    # An explicit schema: nothing is inferred from the first row, and a row that
    # is too short has nulls.
    raw = (spark.read.option("header", str(header).lower()).option("enforceSchema", "true")
           .schema(", ".join(f"{c} STRING" for c in cols)).csv(path))
    out = [F.col(cols[key_col]).alias("order_id"),
           F.col(cols[item_col]).cast(item_type).alias("item")]
    if with_order:
        out += [F.col("_metadata.file_path").alias("_file"),
                F.col("_metadata.file_block_start").alias("_block"),
                F.monotonically_increasing_id().alias("_row")]
    return raw.select(*out)
