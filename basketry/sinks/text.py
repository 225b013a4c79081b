"""Text sinks: pairs as ``(a, b)`` lines (K1), basket lines (K2, K3)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from basketry.functions.text import pair_text
from basketry.operators.baskets import basket_lines


def write_pairs_text(pairs: DataFrame, path: str) -> str:
    """K1: one ``(item1, item2)`` line per row, as the reference saves its pairs."""
    pairs.select(pair_text("item1", "item2").alias("value")).write.mode("overwrite").text(path)
    return path


def write_baskets(baskets: DataFrame, path: str, sep: str = " : ",
                  n_files: int | None = None) -> str:
    """K2 (``sep=' : '``) / K3 (``sep=':'``): one ``key<sep>i1 i2`` line per basket.

    Files are written in parallel, one per partition; ``n_files`` deals the
    finished lines out first (``n_files=1`` gives the reference's single file),
    so the aggregate below keeps its own tasks.
    """
    lines = basket_lines(baskets, sep).withColumnRenamed("line", "value")
    if n_files:
        lines = lines.repartition(n_files)
    lines.write.mode("overwrite").text(path)
    return path
