"""Connected components of a graph in a table, by alternating large and small stars.

Every round hooks each node's larger neighbours, then its smaller ones, to the
least node it sees. Least nodes come from aggregates that fold inside the tasks
first, so a node with a third of all edges is no hot group, and nothing but two
numbers per round reaches the driver. Rounds grow with the logarithm of the
graph's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import cut_lineage


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, one: str = "a", other: str = "b") -> DataFrame:
    """``(node, component)`` for each node with an edge to another one; the component is named by its least node.

    Nodes are of any orderable type; null ends and loops link nothing, repeated
    edges count once.
    """
    stars = edges.where(F.col(one) != F.col(other)).select(F.greatest(one, other).alias("u"), F.least(one, other).alias("v")).distinct()
    stars = cut_lineage(stars)
    seen = _fingerprint(stars)
    while seen[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours go to the least node around
        least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
        larger = stars.select(F.col("v").alias("u"), F.col("u").alias("v"))
        hooked = larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the node and its smaller neighbours go to the least of them
        least = _least_neighbour(hooked)
        smaller = hooked.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut_lineage(smaller.unionByName(least.withColumnRenamed("m", "v")).distinct())
        before, seen = seen, _fingerprint(stars)
        if before == seen:
            break
    roots = stars.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
