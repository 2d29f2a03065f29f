"""Connected components of links between documents, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """node, component for each end of links (a, b: long); the component is its smallest node.

    Each round writes its edges as a table and counts them; links and components never reach the driver. A node without
    links has no row; an empty table gives an empty result. Repeated links, loops (a = b) and null ends do no harm: the latter
    two are left out.
    """
    edges, before = links.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")), None
    rows = edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        root = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(root, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(root.select("x", F.col("m").alias("y")))
        edges = materialize(small.where("x <> y").distinct(), "edges", rows)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state.n:
            break
        before, rows = state, state.n
    tops = edges.select(F.col("y").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(tops)
