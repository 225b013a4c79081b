"""The sample recommendation rows and the product ids to ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The reference's sample recommendation inserts
# (productid1, productid2), in its order.
SAMPLE_RECOMMENDATIONS = [
    (8031, 440740), (8632, 382202), (151638, 151643), (159114, 159172),
    (168221, 168224), (168638, 168694), (284011, 429441), (382356, 489765),
    (383150, 383151), (435676, 435677), (12661, 13417), (12638, 13417),
    (12646, 13417), (12731, 13417), (12706, 13417), (247267, 383150),
]

# The reference's list of product ids to ask for, in its order.
SAMPLE_REQUESTS = [8031, 243489, 383150, 168221, 168224, 382356, 284011,
                   159114, 168638, 8632, 13417, 151638, 435676]


def seed_recommendations(spark: SparkSession, rows=None) -> DataFrame:
    """Recommendation rows ``(product_id, rec_id, support)``; support is unknown (1)."""
    rows = SAMPLE_RECOMMENDATIONS if rows is None else rows
    return spark.createDataFrame([(int(a), int(b), 1) for a, b in rows],
                                 "product_id BIGINT, rec_id BIGINT, support BIGINT")


def seed_requests(spark: SparkSession, ids=None) -> DataFrame:
    ids = SAMPLE_REQUESTS if ids is None else ids
    return spark.createDataFrame([(int(i),) for i in ids], "product_id BIGINT")
