"""Connected components by alternating stars; every step pre-aggregates, links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylake.llm._common import cut


def components(links: DataFrame) -> DataFrame:
    """(u, v) links to (node, label): the smallest node of each node's component. Nodes without a link are left out."""
    edges = cut(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.filter("u <> v").distinct(), "large")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        # done when every node has one smaller neighbour, which has none itself
        again = edges.groupBy("u").count().filter("count > 1").select("u")
        chained = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
        if again.unionByName(chained).isEmpty():
            tops = edges.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(tops)
