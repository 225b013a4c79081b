"""Basket pipelines: order tables -> basket text (C5), CSV rows -> baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketry.operators.baskets import basket_lines, build_baskets, csv_order_runs
from basketry.sinks.text import write_baskets
from basketry.sources.tables import order_lines_from_dir
from basketry.sources.text import read_order_csv


def order_baskets(spark: SparkSession, base_dir: str, path: str, sep: str = " : ",
                  n_files: int | None = None) -> str:
    """Orders ⋈ lineitem ⋈ part -> baskets -> ``key : i1 i2`` text files at ``path``."""
    return write_baskets(build_baskets(order_lines_from_dir(spark, base_dir)), path, sep, n_files)


def csv_baskets(spark: SparkSession, path: str, key_col: int = 0, item_col: int = 3,
                min_items: int = 2, header: bool = False, item_type: str = "string") -> DataFrame:
    """CSV order rows grouped by order id, baskets of at least ``min_items``."""
    rows = read_order_csv(spark, path, key_col, item_col, header, item_type)
    return build_baskets(rows, min_items=min_items)


def csv_basket_lines(spark: SparkSession, path: str, **kw) -> DataFrame:
    """B4 + K3: ``key:i1 i2`` lines from CSV order rows."""
    return basket_lines(csv_baskets(spark, path, **kw), sep=":")


def csv_basket_runs(spark: SparkSession, path: str, key_col: int = 0, item_col: int = 3,
                    min_items: int = 2, header: bool = False,
                    item_type: str = "string") -> DataFrame:
    """Runs of consecutive CSV rows with one order id, in file order."""
    rows = read_order_csv(spark, path, key_col, item_col, header, item_type, with_order=True)
    return csv_order_runs(rows, min_items)
