"""Connected components of a link table, by alternating stars, in Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; the component is its least node.

    Each round links a node's greater neighbours, and then its smaller ones, to the least of its neighbours, until no
    link changes: about as many rounds as the logarithm of the longest chain. Least neighbours are found by partial
    sums, so a node with very many links does not meet them in one task.
    """
    edges = links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").dropDuplicates()
    edges = written(edges, "links")
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).dropDuplicates()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(lower.select("u", F.col("m").alias("v"))).dropDuplicates()
        after = written(small, "links")
        if after.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(after, ["u", "v"], "left_anti").isEmpty():
            break
        edges = after
    return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("component"))).dropDuplicates()
