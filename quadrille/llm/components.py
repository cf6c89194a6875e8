"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is one aggregation (with map-side partial minima) and one equi-join that AQE can split where a node is
hot; the links are written to the shared folder after each round, so neither links nor components ever reach the
driver. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: columns a and b of one orderable type; nulls and self-links count for nothing. Returns (node, root),
    root being the smallest node reachable, for every node that a link between different nodes touches, the roots
    themselves included. No links: no rows."""
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    now = materialize(links.select("a", "b").where("a <> b").transform(_small_star), "links")
    seen = mark(now)
    while seen[0]:
        now = materialize(now.transform(_large_star).transform(_small_star), "links")
        if (new := mark(now)) == seen:
            break
        seen = new
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
