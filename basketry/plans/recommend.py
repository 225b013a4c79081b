"""C4: batch recommendation responses with catalog enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.recommend import lookup
from basketry.session import materialized


def respond(requests: DataFrame, recs: DataFrame, catalog: DataFrame, k: int = 5) -> DataFrame:
    """One JSON response per request row: ``(product_id, response)``.

    The response lists ``{description, image}`` objects: the requested product
    first, then its partners (up to ``k`` per direction, ordered by id) that the
    catalog knows; a field the catalog has no value for is null. A product missing from the catalog gets ``''``.

    Every partner list is bounded by ``2k``, so the per-request grouping stays
    small; the catalog joins are ordinary joins the planner sizes itself. The
    requests and the partner lists are written to shared scratch, so that no
    task holds the tables of the lookup and of the catalog joins at once.
    """
    req = materialized(requests.select("product_id"), "requests")
    cat = catalog.select("product_id", "description", "image")
    partners = (materialized(lookup(recs, req, k), "partners")
                .join(cat.withColumnRenamed("product_id", "rec_id"), "rec_id"))
    grouped = materialized(partners.groupBy("product_id").agg(
        F.array_sort(F.collect_list(F.struct("rec_id", "description", "image"))).alias("_p")), "partner-lists")
    # The catalog enters both joins with only its key renamed, so both read one
    # exchange of it; a matched key marks a known product.
    known = cat.withColumnRenamed("product_id", "_cid")
    joined = (req.join(known, req["product_id"] == known["_cid"], "left")
              .withColumn("_known", F.col("_cid").isNotNull()).drop("_cid")
              .join(grouped, "product_id", "left"))
    own = F.struct(F.col("description").alias("description"), F.col("image").alias("image"))
    others = F.transform(F.coalesce(F.col("_p"), F.array()),
                         lambda p: F.struct(p["description"].alias("description"),
                                            p["image"].alias("image")))
    body = F.to_json(F.concat(F.array(own), others), {"ignoreNullFields": "false"})
    return joined.select("product_id",
                         F.when(F.col("_known"), body).otherwise(F.lit("")).alias("response"))
