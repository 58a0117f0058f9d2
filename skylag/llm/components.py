"""Connected components by alternating large and small stars.

Every round links each vertex's larger neighbours, then its smaller ones, to the smallest
vertex around it, until the edges are stars whose centre is the smallest vertex of the
component. Rounds are written to the shared folder, which cuts the lineage. A hub costs a
map-side minimum and a join that can be split; no vertex's neighbours are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylag.session import materialized


def _least(edges: DataFrame) -> DataFrame:
    """The smallest of each vertex u and its neighbours v; written, so that the join to it can be split."""
    return materialized(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")


def _distinct_edges(pairs: DataFrame, name: str) -> DataFrame:
    return materialized(pairs.filter("u <> v").distinct(), name)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (vertex, component) for every vertex that has a link to another one.

    `links` holds pairs of numbers in any direction, repeated or not; loops are ignored.
    The component is the smallest vertex reachable. No links: no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = materialized(edges, "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        linked = both.filter("v > u").join(_least(both), "u")
        stars = _distinct_edges(linked.select(F.col("v").alias("u"), F.col("m").alias("v")), "large_star")
        # Small star: edges now point from the larger end; the vertex itself moves to the minimum too.
        least = _least(stars)
        linked = stars.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = _distinct_edges(linked.unionByName(least.select("u", F.col("m").alias("v"))), "small_star")
        after = edges.agg(F.count(F.lit(1)), F.bit_xor("u"), F.bit_xor("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before or not after[0]:
            break
        before = after
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
