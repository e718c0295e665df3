"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge with the smallest node that it reaches.

    Alternating large and small stars (Kiveris et al., 2014): each round is two
    aggregations and joins over the edges, written to the shared folder, until
    every edge leads to its component's smallest node.  Nodes with very many
    neighbours are pre-aggregated for their minimum; the join that follows has
    one row a node on its other side, so its partitions can be split.  Loops and
    repeated edges do no harm; edges with a null end are dropped.
    """
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                      .filter("u is not null and v is not null and u <> v").distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        after = materialize(small, "edges")
        # settled: every node has one edge, and it leads to a node that has none
        many = after.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1)
        onward = after.join(after.select(F.col("u").alias("v")), "v", "left_semi").select("u").limit(1)
        now = after
        if not many.count() and not onward.count():
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
