"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

BROADCAST = 200_000  # rows of two ids that are sent to all executors at most


def _is_stars(edges: DataFrame) -> bool:
    """Whether every id hangs on one id that hangs on none."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` with the least id of the component, for every linked id.

    Each round hangs larger neighbours onto the smallest one (large step) and
    then smaller ones likewise (small step) until only stars are left; the number
    of rounds grows with the logarithm of the path length.  Only minima are
    aggregated, neighbour lists are never collected, and each round's edges are a
    written table.
    """
    edges = materialise(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    while not _is_stars(edges):
        fit = F.broadcast if edges.count() <= BROADCAST else lambda t: t
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(fit(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # every edge of the large step already points from the larger to the smaller id
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        hang = large.join(fit(parent), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(hang.unionByName(parent.select("u", F.col("m").alias("v"))).distinct(), "edges")
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
