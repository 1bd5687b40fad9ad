"""Connected components by alternating large-star and small-star steps.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).
Each step is a grouped minimum and a join, so no node's neighbours are
gathered in one place.  The edge list is checkpointed after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every node in ``links`` (a, b); component is the least id reachable.

    Links may repeat, point either way or join a node to itself; nulls are ignored.
    An empty input gives an empty result.
    """
    shared_dir(links.sparkSession)
    kept = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = kept.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    while not _all_stars(edges):
        edges = _small_star(_large_star(edges)).checkpoint()
    nodes = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, and none if it has a larger one."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.agg(F.coalesce(F.max(F.when((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)), 1).otherwise(0)), F.lit(0))).first()[0] == 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node that it sees, itself included."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
