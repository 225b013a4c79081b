"""In-basket pair generation (G2 on arrays, J6 as a blocked self-join).

Output shape of both paths: ``(order_id, item1, item2, n)`` with
``item1 <= item2`` and ``n`` the number of position pairs of the sorted basket
that carry this item pair. Baskets with repeated items therefore give self
pairs ``(v, v)`` and counts above one, exactly as pairing positions does.

The self-join path works on lines and never gathers a basket in one row.
Baskets of normal size join on ``order_id``. A basket estimated (from a small
sample) to hold ``d > block_size`` distinct items is split: its items are
hashed into ``b = ceil(d / block_size)`` blocks, the join key is
``(order_id, block_of_item1, block_of_item2)`` and each row is copied once per
block of the other side, so the basket becomes ``b * b`` tasks' worth of keys
of about ``block_size`` rows a side and no task gets the whole basket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.groups import check_group_size, item_groups, item_pairs
from basketry.operators.baskets import basket_items, is_array_baskets, shared_items
from basketry.operators.membership import MAX_BROADCAST_ROWS
from basketry.session import dealt, materialized, tasks_of

DEFAULT_BLOCK_SIZE = 4096
DEFAULT_SAMPLE_FRACTION = 0.01
#: Occurrences that one generated step stands for.
EXPAND_STEP = 1 << 16


def array_pair_occurrences(baskets: DataFrame) -> DataFrame:
    """Pairs of each basket array; narrow (no shuffle), one row per position pair."""
    return (baskets.select("order_id", F.explode(item_pairs("items")).alias("p"))
            .select("order_id", F.col("p.item1").alias("item1"), F.col("p.item2").alias("item2"),
                    F.lit(1).cast("bigint").alias("n")))


def hot_baskets(items: DataFrame, block_size: int = DEFAULT_BLOCK_SIZE,
                sample_fraction: float = DEFAULT_SAMPLE_FRACTION, seed: int = 17) -> DataFrame:
    """Baskets estimated to hold more than ``block_size`` distinct items: ``(order_id, _nb)``.

    The estimate counts a sample of the ``(order_id, item, mult)`` rows, so
    only a small fraction is shuffled. Rows are picked by a hash of their whole
    content, not by position, so a recomputed partition (after a lost executor)
    picks the same rows and every basket keeps its path. The
    estimate only decides how a basket's pairs are split into tasks, never
    which pairs are produced: a basket it misses is paired by the plain join.
    """
    scale = 1 << 20
    picked = F.pmod(F.xxhash64(F.lit(seed), "order_id", "item", "mult"),
                    F.lit(scale)) < F.lit(int(sample_fraction * scale))
    est = (items.where(picked)
           .groupBy("order_id").agg((F.count(F.lit(1)) / F.lit(sample_fraction)).alias("_est")))
    return (est.where(F.col("_est") > F.lit(block_size))
            .select("order_id", F.greatest(F.lit(2), F.ceil(F.col("_est") / F.lit(block_size)))
                    .cast("int").alias("_nb")))


def _blocked_pairs(tagged: DataFrame, rows: int = 0) -> DataFrame:
    """Pairs of baskets split into ``_nb`` item blocks: join key (order, block1, block2). ``rows``: about
    how many there are of one side, with their copies."""
    key = ["order_id", "_b1", "_b2"]
    tagged = tagged.withColumn("_blk", F.pmod(F.xxhash64("item"), F.col("_nb")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))
    a = tagged.select("order_id", F.col("_blk").alias("_b1"), others.alias("_b2"),
                      F.col("item").alias("item1"), F.col("mult").alias("_m1"))
    b = tagged.select("order_id", others.alias("_b1"), F.col("_blk").alias("_b2"),
                      F.col("item").alias("item2"), F.col("mult").alias("_m2"))
    return dealt(a, rows, *key).join(dealt(b, rows, *key), key).where(F.col("item1") <= F.col("item2"))


def _plain_pairs(items: DataFrame, rows: int = 0) -> DataFrame:
    """Pairs of ``items``, which has about ``rows`` rows; both sides read one exchange."""
    items = dealt(items, rows, "order_id")
    a = items.select("order_id", F.col("item").alias("item1"), F.col("mult").alias("_m1"))
    b = items.select("order_id", F.col("item").alias("item2"), F.col("mult").alias("_m2"))
    return a.join(b, "order_id").where(F.col("item1") <= F.col("item2"))


def _item_pair_rows(lines: DataFrame, block_size: int | None,
                    sample_fraction: float) -> DataFrame:
    """``(order_id, item1, item2, _m1, _m2)``: each pair of distinct items of a
    basket with ``item1 <= item2`` (every item with itself too) and their
    multiplicities. Baskets flagged by ``hot_baskets`` take the blocked join."""
    if block_size is None:
        return _plain_pairs(basket_items(lines))
    if block_size < 1:
        raise ValueError("block_size must be >= 1")
    items = shared_items(lines)
    hot_set = materialized(hot_baskets(items, block_size, sample_fraction), "hot-baskets")
    rows = items.count()
    if hot_set.isEmpty():
        return _plain_pairs(items, rows)
    copies = hot_set.agg(F.sum(F.col("_nb").cast("bigint") * F.col("_nb") * block_size)).first()[0]
    # at most one hot basket for each block_size rows of the sample: small, and never shuffled against
    hot_set = F.broadcast(hot_set) if hot_set.count() <= MAX_BROADCAST_ROWS else hot_set
    normal = items.join(hot_set, "order_id", "left_anti")
    hot = items.join(hot_set, "order_id")
    return _plain_pairs(normal, rows).unionByName(
        _blocked_pairs(hot, copies).select("order_id", "item1", "item2", "_m1", "_m2"))


def self_join_pair_occurrences(lines: DataFrame,
                               block_size: int | None = DEFAULT_BLOCK_SIZE,
                               sample_fraction: float = DEFAULT_SAMPLE_FRACTION) -> DataFrame:
    """Pairs of each basket by joining its lines with themselves.

    Baskets flagged by ``hot_baskets`` take the blocked join; all others join
    on ``order_id`` (both sides read one shuffle). ``block_size=None`` skips
    the detection and leaves skew to AQE's skew-join splitting alone.
    """
    cross = _item_pair_rows(lines, block_size, sample_fraction)
    # The join pairs every item with itself as well: such a row stands for the
    # m(m-1)/2 position pairs of an item repeated m times (none when m = 1).
    n = F.when(F.col("item1") == F.col("item2"),
               F.shiftright(F.col("_m1") * (F.col("_m1") - 1), 1)).otherwise(
        F.col("_m1") * F.col("_m2"))
    return (cross.select("order_id", "item1", "item2", n.alias("n"))
            .where(F.col("n") > F.lit(0)))


def dealt_pairs(pairs: DataFrame, baskets: DataFrame, *cols: str, items_only: bool = True) -> DataFrame:
    """``pairs`` made of ``baskets`` (arrays, or items with ``mult``), dealt out by ``cols`` to be grouped by these.

    Their number comes from the basket sizes, without making them. Where all pairs of the items that
    there are fit in one task, tasks group before they send, so the planner's exchange is kept;
    ``items_only=False`` says that ``cols`` are no item pairs, so that this doesn't hold.
    """
    arrays = is_array_baskets(baskets)
    items = (baskets.select(F.explode("items").alias("item")) if arrays else baskets).agg(
        F.approx_count_distinct("item")).first()[0]
    if items_only and not tasks_of(baskets.sparkSession, items * (items + 1) // 2):
        return pairs
    if arrays:
        sizes = baskets.select(F.size("items").cast("bigint").alias("d"))
    else:
        sizes = dealt(baskets.select("order_id"), baskets.count(), "order_id").dropna().groupBy("order_id").agg(
            F.count(F.lit(1)).alias("d"))
    rows = sizes.agg(F.coalesce(F.sum(F.expr("d * (d + 1) div 2")), F.lit(0))).first()[0]
    return dealt(pairs, rows, *cols)


def ranked_items(lines: DataFrame) -> DataFrame:
    """``(order_id, item, mult, first, size)``: where each distinct item starts in its sorted basket.

    Positions are prefix counts over item ranges. The ``(order_id, item)`` rows, which are distinct, are
    range-partitioned by both columns, so a basket of any size is cut into chunks of at most one
    partition. Items are counted up inside their chunk, and the chunks of a basket (at most as many as
    there are partitions) inside the basket. Runs a job: the rows are written to shared scratch.
    """
    items = shared_items(lines)
    rows = items.count()
    items = materialized(items.repartitionByRange(*tasks_of(items.sparkSession, rows), "order_id", "item")
                         .withColumn("_c", F.spark_partition_id()), "item-ranges")
    items = dealt(items, rows, "order_id", "_c")
    upto = Window.partitionBy("order_id", "_c").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    inside = items.withColumn("_before", F.coalesce(F.sum("mult").over(upto), F.lit(0)))
    basket = Window.partitionBy("order_id")
    earlier = basket.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (dealt(items.groupBy("order_id", "_c").agg(F.sum("mult").alias("_n")), rows, "order_id")
              .select("order_id", "_c", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
                      F.sum("_n").over(basket).alias("size")))
    return materialized(
        inside.join(chunks, ["order_id", "_c"])
        .select("order_id", "item", "mult", (F.col("_offset") + F.col("_before")).alias("first"), "size"),
        "ranked-items")


def _positions(ranked: DataFrame) -> DataFrame:
    """``(order_id, _i, item, size)``: one row per position of each sorted basket. A repeated item is
    cut into steps of ``EXPAND_STEP`` first, so no row holds all its positions."""
    end = F.col("first") + F.col("mult") - 1
    start = F.col("first") + F.col("_s") * EXPAND_STEP
    steps = ranked.select("order_id", "item", "size", "first", "mult", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.shiftright(F.col("mult") - 1, 16))).alias("_s"))
    return steps.select("order_id", F.explode(F.sequence(start, F.least(end, start + (EXPAND_STEP - 1)))).alias("_i"),
                        "item", "size")


def group_occurrences(lines: DataFrame, k: int, block_size: int | None = DEFAULT_BLOCK_SIZE,
                      ranked: DataFrame | None = None) -> DataFrame:
    """G1-G3 on lines for any k: ``(order_id, item1 .. itemk, n)``.

    The groups of a sorted basket are k-1 items in a row and any later one: ``(b[i], .., b[i+k-2], b[j])``
    with ``j >= i + k - 1``. The items in a row come from equi-joins on ``(order_id, position)``, a key
    that every row has alone. A later item joins by range: it stands from ``first`` to its end, so it
    gives ``n`` groups, one for each of its positions from ``i + k - 1`` on. Baskets above ``block_size``
    positions are cut into blocks of positions; a base meets each block it can reach under a key of
    its own, so no key holds more than ``block_size`` bases and items. A group whose items start at
    several positions has a row for each. ``ranked`` (from ``ranked_items``) may be given to share it.
    """
    check_group_size(k)
    if k == 1:
        return basket_items(lines).select("order_id", F.col("item").alias("item1"), F.col("mult").alias("n"))
    ranked = ranked_items(lines) if ranked is None else ranked
    positions = _positions(ranked)
    base = positions.withColumnRenamed("item", "item1").where(F.col("_i") + (k - 1) < F.col("size"))
    for t in range(1, k - 1):
        base = base.join(positions.select("order_id", (F.col("_i") - t).alias("_i"), F.col("item").alias(f"item{t + 1}")),
                         ["order_id", "_i"])
    wide = F.lit(block_size) if block_size else F.col("size")
    block = lambda place: F.floor(place / wide).cast("int")
    reach = F.col("_i") + (k - 1)
    rows = ranked.agg(F.coalesce(F.sum(F.col("mult") * (F.floor(F.col("size") / wide) + 1)), F.lit(0))).first()[0]
    base = base.withColumn("_b1", block(F.col("_i"))).withColumn(
        "_b2", F.explode(F.sequence(block(reach), block(F.col("size") - 1))))
    end = F.col("first") + F.col("mult") - 1
    later = ranked.select("order_id", F.col("item").alias(f"item{k}"), "first", end.alias("_end"),
                          block(end).alias("_b2"))
    later = later.withColumn("_b1", F.explode(F.sequence(F.lit(0), F.col("_b2"))))
    key = ["order_id", "_b1", "_b2"]
    return (dealt(base.drop("size"), rows, *key).join(dealt(later, rows, *key), key).where(F.col("_end") >= reach)
            .select("order_id", *[f"item{t}" for t in range(1, k + 1)],
                    (F.col("_end") - F.greatest("first", reach) + 1).cast("bigint").alias("n")))


def pair_occurrences(df: DataFrame, block_size: int | None = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """Pairs of baskets given as arrays or as lines.

    Lines take the self-join path. Arrays of at most ``block_size`` items are
    expanded in place (narrow, no shuffle); larger arrays are exploded to lines
    and take the self-join path, so one giant basket row is never expanded
    quadratically inside one task.
    """
    if not is_array_baskets(df):
        return self_join_pair_occurrences(df, block_size)
    if block_size is None:
        return array_pair_occurrences(df)
    size = F.size("items")
    small = array_pair_occurrences(df.where(size <= block_size))
    big_lines = df.where(size > block_size).select("order_id", F.explode("items").alias("item"))
    return small.unionByName(self_join_pair_occurrences(big_lines, block_size))


def basket_groups(baskets: DataFrame, k: int, block_size: int | None = DEFAULT_BLOCK_SIZE,
                  ranked: DataFrame | None = None) -> DataFrame:
    """``(order_id, group, n)``: the k-groups of baskets given as arrays or as lines.

    Arrays of at most ``block_size`` items are expanded in place; larger ones, and lines, go through
    ``group_occurrences`` (pairs through the pair join), so no basket is expanded inside one row.
    """
    if is_array_baskets(baskets):
        size = F.size("items")
        small = baskets.where(size <= block_size) if block_size else baskets
        out = small.select("order_id", F.explode(item_groups("items", k)).alias("group"),
                           F.lit(1).cast("bigint").alias("n"))
        if not block_size:
            return out
        big = baskets.where(size > block_size).select("order_id", F.explode("items").alias("item"))
        return out.unionByName(basket_groups(big, k, block_size))
    rows = (self_join_pair_occurrences(baskets, block_size) if k == 2 and ranked is None
            else group_occurrences(baskets, k, block_size, ranked))
    return rows.select("order_id", F.array(*[f"item{t}" for t in range(1, k + 1)]).alias("group"), "n")


def expand_occurrences(pairs: DataFrame, cols=("order_id", "item1", "item2")) -> DataFrame:
    """One row per pair occurrence (``n`` copies), as the reference's pair RDD holds.

    A count is first cut into steps of ``EXPAND_STEP``, then each step is
    expanded, so no row ever holds an array of all its copies.
    """
    return (occurrence_steps(pairs, cols)
            .select(*cols, F.explode(F.sequence(F.lit(1), F.col("_step"))).alias("_k")).drop("_k"))


def occurrence_steps(pairs: DataFrame, cols) -> DataFrame:
    """``(cols, _step)``: rows whose ``_step`` (at most ``EXPAND_STEP``) add up to ``n``."""
    last = F.shiftright(F.col("n") - 1, 16)
    return (pairs.where(F.col("n") > 0)
            .select(*cols, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_s"))
            .select(*cols, F.least(F.lit(EXPAND_STEP).cast("bigint"),
                                   F.col("n") - F.col("_s") * EXPAND_STEP).cast("int").alias("_step")))
