"""Connected components by alternating large and small stars, each step a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.sources.staging import pin


#: Edges up to this number are worked off by one task.
ONE_TASK = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the edges (a, b), for every node of an edge.

    Edges with a null end or two equal ends are left out. A node with very many edges is aggregated
    before it is shuffled; its edges are spread by the skew handling of the join.
    """
    e = edges.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = pin(e.filter("u > v").distinct(), "edges")
    # A few megabytes need no shuffle: in one partition the steps below run without one.
    few = e.count() <= ONE_TASK
    e = e.coalesce(1) if few else e
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        # Large star: every greater neighbour of a node hangs on the node's least neighbour or itself.
        sides = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("side")
        both = e.select(sides).select("side.u", "side.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        # Small star: a node and its smaller neighbours hang on the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = hung.unionByName(least.select("u", F.col("m").alias("v")))
        e = pin((hung.coalesce(1) if few else hung).distinct(), "edges")
        e = e.coalesce(1) if few else e
    stars = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
