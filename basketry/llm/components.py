"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import staged


def _star(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest node among u and its neighbours v."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.join(_star(both), "u").filter("v > u AND v <> m")
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    low = _star(edges)
    moved = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")).filter("u <> v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (two columns), component being its smallest node.

    Nodes without a link to another node don't occur. Repeated links and links of a node with
    itself change nothing. Each step aggregates before it joins, so a node with very many links is
    reduced map-side, and is written to shared scratch; only a row count and a checksum reach the
    driver.
    """
    a, b = links.columns
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges, seen = staged(edges.distinct(), "links"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == tuple(state) or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select("v", "v").distinct())
        seen = tuple(state)
        edges = staged(_small(_large(edges)), "links")
