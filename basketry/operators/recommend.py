"""Recommendation tables and lookups.

A recommendation table is ``(product_id, rec_id, support)``: product
``product_id`` is bought with ``rec_id``. It is stored in one direction (as the
pairs come out, ``product_id < rec_id``); lookups read both directions, which
replaces the reference's secondary index on the second column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import materialized
from basketry.sinks.tables import write_bucketed

FORWARD = "forward"
BACKWARD = "backward"


def recommendations_from_pairs(pairs: DataFrame, include_self: bool = False) -> DataFrame:
    """Frequent pairs ``(item1, item2, support)`` -> recommendation rows."""
    out = pairs.select(F.col("item1").alias("product_id"), F.col("item2").alias("rec_id"),
                       F.col("support").cast("bigint").alias("support"))
    return out if include_self else out.where(F.col("product_id") != F.col("rec_id"))


def upsert_recommendations(recs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """K6: one row per ``product_id``, as a table keyed on it alone keeps.

    The reference keeps whichever write came last; here the survivor is fixed:
    rows of ``recs`` win over ``existing``, then the highest support, then the
    lowest ``rec_id``. This is an aggregate (``max_by``), merged map-side, so a
    product with very many partners is never gathered in one task.
    """
    rows = recs.select("product_id", "rec_id", "support", F.lit(1).alias("_new"))
    if existing is not None:
        rows = rows.unionByName(existing.select("product_id", "rec_id", "support",
                                                F.lit(0).alias("_new")))
    rank = F.struct("_new", "support", (-F.col("rec_id")).alias("_neg"))
    best = F.max_by(F.struct("rec_id", "support"), rank)
    return (rows.groupBy("product_id").agg(best.alias("_b"))
            .select("product_id", F.col("_b.rec_id").alias("rec_id"),
                    F.col("_b.support").alias("support")))


def merge_recommendations(recs: DataFrame, path: str, parts: int = 64) -> str:
    """K6 as an incremental merge: ``recs`` upserted into the table at ``path``, made if absent.

    The table is partitioned by a hash of ``product_id`` into ``parts`` folders. Only folders that ``recs``
    has products of are read, merged (by ``upsert_recommendations``) and overwritten; all other files
    stay as they are. The merged rows are written to shared scratch first, since they come from the
    folders they replace.
    """
    spark = recs.sparkSession
    part = F.pmod(F.xxhash64("product_id"), F.lit(parts)).cast("int").alias("part")
    recs = recs.select("product_id", "rec_id", "support")
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    before = None
    if jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        touched = [r["part"] for r in recs.select(part).distinct().collect()]  # at most ``parts`` numbers
        before = spark.read.parquet(path).where(F.col("part").isin(touched)).drop("part")
    merged = materialized(upsert_recommendations(recs, before).withColumn("part", part), "merged")
    (merged.repartition(parts, "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("part").parquet(path))
    return path


def save_partners(recs: DataFrame, path: str, name: str, buckets: int = 64) -> str:
    """Partners in both directions as table ``name``, bucketed and sorted by ``product_id``, with
    Parquet bloom filters: either column of the recommendations is then looked up by its key."""
    write_bucketed(both_directions(recs), path, name, "product_id", buckets, bloom=True)
    return name


def lookup_stored(spark, name: str, requests: DataFrame, k: int = 5, max_listed: int = 1000) -> DataFrame:
    """C3 from the table of ``save_partners``: ``(product_id, rec_id)`` for each requested product.

    Up to ``max_listed`` requests become a list in the scan's filter: buckets, row groups (sorted) and
    bloom filters leave out what can't hold them. More meet the table bucket by bucket, without moving it.
    """
    stored, wanted = spark.table(name), requests.select("product_id").distinct()
    listed = [r["product_id"] for r in wanted.limit(max_listed + 1).collect()]
    if len(listed) <= max_listed:
        rows = stored.where(F.col("product_id").isin([x for x in listed if x is not None]))
    else:
        rows = stored.join(wanted.hint("merge"), "product_id", "left_semi")
    w = Window.partitionBy("product_id", "direction").orderBy(F.desc("support"), F.asc("rec_id"))
    return (rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("product_id", "rec_id").distinct())


def both_directions(recs: DataFrame) -> DataFrame:
    """Rows for each direction: ``(product_id, rec_id, support, direction)``."""
    fwd = recs.select("product_id", "rec_id", "support", F.lit(FORWARD).alias("direction"))
    bwd = recs.select(F.col("rec_id").alias("product_id"), F.col("product_id").alias("rec_id"),
                      "support", F.lit(BACKWARD).alias("direction"))
    return fwd.unionByName(bwd)


def top_partners(recs: DataFrame, k: int = 5, requests: DataFrame | None = None) -> DataFrame:
    """O2: up to ``k`` partners per product and direction, best support first.

    Ties are broken by the lower partner id (the reference's ``LIMIT 5`` has no
    order). ``row_number() <= k`` lets Spark insert a partial per-group limit
    before the shuffle (WindowGroupLimit), so each map task sends at most k rows
    per product and direction, however popular the product.
    """
    rows = both_directions(recs)
    if requests is not None:
        # A semi join ignores repeated keys on its right side, so the requests
        # need no distinct of their own (and the same scan can serve the caller).
        rows = rows.join(requests.select("product_id"), "product_id", "left_semi")
    w = Window.partitionBy("product_id", "direction").orderBy(F.desc("support"), F.asc("rec_id"))
    return (rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


def rec_union(recs: DataFrame) -> DataFrame:
    """Every partner of every product, either direction, duplicates removed."""
    return both_directions(recs).select("product_id", "rec_id").distinct()


def lookup(recs: DataFrame, requests: DataFrame, k: int = 5) -> DataFrame:
    """C3 (P9, O2, U1): partners of each requested product, ``(product_id, rec_id)``.

    A table of requests is answered in one join instead of one query per id.
    """
    return top_partners(recs, k, requests).select("product_id", "rec_id").distinct()


def recs_preview(recs: DataFrame, n: int = 2000) -> DataFrame:
    """O3: the first ``n`` recommendation rows by ``(product_id, rec_id)`` (a top-n)."""
    return recs.orderBy("product_id", "rec_id").limit(n)
