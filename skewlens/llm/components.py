"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewlens.session import stage


def components(links: DataFrame) -> DataFrame:
    """``(node, component)``: the smallest node reachable, for every node that has a link.

    ``links`` is ``(a, b)`` of comparable ids, in any direction, repeats and self-links
    allowed. Each round hangs the neighbours of a node below its smallest one, first the
    larger neighbours, then the smaller. Only minima are gathered per node, so a node with
    very many links is pre-aggregated. Each round is written, so a lost executor costs a
    re-read. An empty table gives an empty table.
    """
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges = stage(edges.distinct(), "links")
    seen = _signature(edges)
    while True:  # every round shortens the longest chains; it ends when none is left
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        larger = both.join(least, "u").where(F.col("v") > F.col("u"))
        star = larger.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        below = star.join(least, "u").where(F.col("v") != F.col("m"))
        below = below.select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(below.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
        now = _signature(edges)
        if now == seen:
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                roots.select("node", F.col("node").alias("component"))
            )
        seen = now


def _signature(edges: DataFrame):
    return tuple(
        edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
    )
