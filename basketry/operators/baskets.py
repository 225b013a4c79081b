"""Basket building: grouped baskets (B1, B2, B4), size filter (P7), runs.

Two basket shapes are used throughout the package:

* **lines** ``(order_id, item)``: one row per order line. This is the shape
  the heavy operators work on, because a basket is spread over many rows and
  can be split across tasks.
* **baskets** ``(order_id, items array)``: one row per basket, as in basket
  text files. Building it gathers a basket into one row, which is what the
  text format needs; operators that only count never build it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from basketry.functions.text import basket_line
from basketry.session import dealt, materialized, tasks_of


def is_array_baskets(df: DataFrame, items_col: str = "items") -> bool:
    return items_col in df.columns and isinstance(df.schema[items_col].dataType, ArrayType)


def as_lines(df: DataFrame, key: str = "order_id") -> DataFrame:
    """G1: baskets -> one ``(order_id, item)`` row per element; lines pass through."""
    if is_array_baskets(df):
        return df.select(F.col(key), F.explode("items").alias("item"))
    return df.select(key, "item")


def build_baskets(lines: DataFrame, key: str = "order_id", item: str = "item",
                  min_items: int = 0) -> DataFrame:
    """B1 (+P7): ``(order_id, items)`` with the items of each order sorted (O1).

    Duplicates are kept. The reference's concatenation order is undefined, so
    the items are sorted for a deterministic answer.
    """
    out = (lines.groupBy(F.col(key).alias("order_id"))
           .agg(F.sort_array(F.collect_list(item)).alias("items")))
    return min_basket(out, min_items) if min_items > 0 else out


def min_basket(baskets: DataFrame, n: int) -> DataFrame:
    """Keep baskets holding at least ``n`` items (arrays, or lines with no gathering)."""
    if is_array_baskets(baskets):
        return baskets.where(F.size("items") >= n)
    big = baskets.groupBy("order_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
    return baskets.join(big.select("order_id"), "order_id", "left_semi")


def basket_concat(baskets: DataFrame, sep: str = " ") -> DataFrame:
    """B2: the items of each basket as one string."""
    return baskets.select("order_id", F.array_join(
        F.transform("items", lambda x: x.cast("string")), sep).alias("items"))


def basket_lines(baskets: DataFrame, sep: str = " : ") -> DataFrame:
    """K2/K3 text: one ``line`` per basket (F1)."""
    return baskets.select(basket_line("order_id", "items", sep).alias("line"))


def basket_items(lines: DataFrame) -> DataFrame:
    """Distinct items per basket with their multiplicity: ``(order_id, item, mult)``.

    Rows that have ``mult`` already pass through. The lines are dealt out by
    both keys first, so a basket that holds a third of all lines is spread
    over all tasks even where the join below has dealt them by order. They are
    written to shared scratch before, so that their number sets that of the tasks.
    """
    if "mult" in lines.columns:
        return lines.select("order_id", "item", "mult")
    lines = materialized(lines.select("order_id", "item"), "order-lines")
    tasks = tasks_of(lines.sparkSession, lines.count())
    return (lines.repartition(*tasks, "order_id", "item").groupBy("order_id", "item")
            .agg(F.count(F.lit(1)).alias("mult")))


def shared_items(baskets: DataFrame) -> DataFrame:
    """The items of each basket, computed once for all branches of a plan.

    Lines become ``(order_id, item, mult)`` written to shared scratch; basket
    arrays are returned as they are (their pairs need no shuffle).
    """
    if is_array_baskets(baskets) or "mult" in baskets.columns:
        return baskets
    return materialized(basket_items(baskets), "basket-items")


#: Neighbours that one step of the scan over summaries combines.
FAN = 256


def _stitched(summary: DataFrame, order: list[str]) -> DataFrame:
    """``(<order>, _first_true, _offset)`` for chunk summaries ``(<order>, _first_key, _last_key, _nb)``:
    whether the chunk's first run is a new one, and the runs that begin before the chunk.

    A scan over a tree: the summaries are range-partitioned in their order and combined inside each
    partition; the partitions' summaries, numbered in that order, are combined in groups of ``FAN``,
    these again, until one is left; what lies to the left of a group then goes down to its members.
    Summaries combine associatively: a first key, a last key, and the runs that begin inside if nothing
    precedes. No window spans more than one partition of summaries or ``FAN`` of them.
    """
    spark = summary.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = materialized(summary.repartitionByRange(parts, *order).withColumn("_g", F.spark_partition_id())
                         .withColumn("_true", F.col("_nb")), "chunk-summaries")
    levels = []
    keys = order
    while True:
        w = Window.partitionBy("_g").orderBy(*keys)
        new = F.lag(F.lit(1)).over(w).isNull() | ~F.lag("_last_key").over(w).eqNullSafe(F.col("_first_key"))
        level = (level.withColumn("_head", F.lag(F.lit(1)).over(w).isNull())
                 .withColumn("_new", F.when(new, 1).otherwise(0))
                 # a member's runs if its first one only counts when it is new
                 .withColumn("_runs", F.col("_true") - 1 + F.col("_new")))
        level = level.withColumn("_left", F.coalesce(F.sum("_runs").over(
            w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        levels.append((level, keys))
        if parts == 1:
            break
        place = F.struct(*keys)
        level = materialized(level.groupBy(F.col("_g").alias("_i")).agg(
            F.min_by("_first_key", place).alias("_first_key"), F.max_by("_last_key", place).alias("_last_key"),
            F.sum("_runs").alias("_true")).withColumn("_g", F.floor(F.col("_i") / FAN).cast("int")), "group-summaries")
        keys, parts = ["_i"], -(-parts // FAN)
    # down again: (_new, _offset) of each group, known from the level above
    above = None
    for level, keys in reversed(levels):
        if above is None:
            known = level.withColumn("_offset", F.col("_left").cast("bigint"))
        else:
            group = above.select(F.col("_i").alias("_g"), F.col("_new").alias("_gnew"), F.col("_offset").alias("_goff"))
            known = level.join(group, "_g").withColumn("_offset", (
                F.col("_goff") + F.when(F.col("_head"), 0).otherwise(F.col("_left") - 1 + F.col("_gnew"))).cast("bigint"))
            known = known.withColumn("_new", F.when(F.col("_head"), F.col("_gnew")).otherwise(F.col("_new")))
        above = known
    return above.select(*order, F.col("_new").alias("_first_true"), "_offset")


#: Rows that a row with its place among the chunks (the path of its file) counts as.
WIDE = 4


def _runs(df: DataFrame, key: str, item: str, order: Sequence[str],
          chunk: Sequence[Column | str]) -> tuple[DataFrame, int]:
    """Rows with a global run id ``_run`` (plus ``_key``, ``_item`` and the order columns), and how many
    plain rows they count as."""
    order = list(order)
    chunk_cols = [F.col(c) if isinstance(c, str) else c for c in chunk]
    ck = [f"_ck{i}" for i in range(len(chunk_cols))]
    rows = WIDE * df.count()
    base = dealt(df.select(*[c.alias(n) for c, n in zip(chunk_cols, ck)], F.col(key).alias("_key"),
                           F.col(item).alias("_item"), *[F.col(o) for o in order]), rows, *ck)
    w = Window.partitionBy(*ck).orderBy(*order)
    prev = F.lag("_key").over(w)
    first = F.row_number().over(w) == 1
    brk = F.when(first | ~prev.eqNullSafe(F.col("_key")), 1).otherwise(0)
    local = (base.withColumn("_brk", brk)
             .withColumn("_local", F.sum("_brk").over(
                 w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    pos = F.struct(*order)
    summary = local.groupBy(*ck).agg(
        F.min_by("_key", pos).alias("_first_key"),
        F.max_by("_key", pos).alias("_last_key"),
        F.sum("_brk").alias("_nb"))
    summary = _stitched(summary, ck)
    runs = (local.join(summary, ck)
            .withColumn("_run", F.col("_offset") + F.col("_local") - (1 - F.col("_first_true")))
            .select("_run", "_key", "_item", *order))
    return runs, rows


def basket_run_rows(df: DataFrame, key: str, item: str, order: Sequence[str],
                    chunk: Sequence[Column | str], min_items: int = 1) -> DataFrame:
    """B5, one row per input row: ``(key, run_start, n_items, <order cols>, item)``.

    Consecutive rows (in ``order``) with the same key form a run. ``chunk``
    names column(s) that cut the ordered rows into contiguous ranges (all rows
    of a chunk come before all rows of the next). Run breaks are found with a
    window per chunk; a scan over a tree of the per-chunk summaries stitches
    runs that cross chunk borders. Run sizes come from an
    aggregate joined back, so no step gathers a run, a key or all rows in one
    task.
    """
    order = list(order)
    runs, _ = _runs(df, key, item, order, chunk)
    start = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    stats = runs.groupBy("_run").agg(F.min(start).alias("run_start"),
                                     F.count(F.lit(1)).alias("n_items"))
    if min_items > 1:
        stats = stats.where(F.col("n_items") >= min_items)
    return runs.join(stats, "_run").select(F.col("_key").alias("key"), "run_start", "n_items",
                                           *order, F.col("_item").alias("item"))


def basket_runs(df: DataFrame, key: str, item: str, order: Sequence[str],
                chunk: Sequence[Column | str], min_items: int = 1) -> DataFrame:
    """B5 as baskets: ``(key, run_start, n_items, items)``, items in row order.

    One row per run, as a basket line needs; ``basket_run_rows`` gives the
    same runs without gathering each one into an array.
    """
    order = list(order)
    runs, rows = _runs(df, key, item, order, chunk)
    pos = F.struct(*order)
    start = F.col(order[0]) if len(order) == 1 else pos
    grouped = dealt(runs, rows, "_run").groupBy("_run").agg(
        F.min_by("_key", pos).alias("key"),
        F.min(start).alias("run_start"),
        F.count(F.lit(1)).alias("n_items"),
        F.collect_list(F.struct(pos.alias("_p"), F.col("_item").alias("_i"))).alias("_items"))
    out = grouped.select("key", "run_start", "n_items",
                         F.transform(F.array_sort("_items"), lambda s: s["_i"]).alias("items"))
    return out.where(F.col("n_items") >= min_items) if min_items > 1 else out


def csv_order_runs(rows: DataFrame, min_items: int = 2) -> DataFrame:
    """B5 on CSV rows read with ``with_order=True``: runs in file order."""
    return basket_runs(rows, "order_id", "item", ["_file", "_block", "_row"],
                       ["_file", "_block"], min_items)
