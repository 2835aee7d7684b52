"""Connected components of a graph of links by alternating large and small stars, wholly in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmark.llm.arrow import stored


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v) but the roots; the root is the smallest node of its component.

    A round joins every edge with the minimum of its end's neighbours, so a node with many neighbours is an aggregate and
    a join that Spark may split. Rounds are written to the shared folder; their number grows with the logarithm of the
    longest path.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        # done when every node hangs on one root, and no root hangs on another node
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(True).alias("hangs")), F.struct(F.col("v").alias("node"), F.lit(False).alias("hangs")))).alias("e"))
        nodes = ends.select("e.*").groupBy("node").agg(F.count_if("hangs").alias("up"), F.count_if(~F.col("hangs")).alias("down"))
        if nodes.filter("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
