"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernlake.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for each node of the edges (a, b) of longs.

    Each round points every node's larger neighbours, then its smaller ones, to
    the least it can see, so paths shorten by doubling; rounds go on until the edges no
    longer change. Every round's edges are written to the checkpoint folder.
    Edges from a node to itself give the node as its own root; no edges give no rows.
    """
    own = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    of = Window.partitionBy("u")
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        large = both.withColumn("m", F.least(F.min("v").over(of), "u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.withColumn("m", F.min("v").over(of))  # here u > v always
        e = cut(low.select(F.col("u"), F.col("m").alias("v")).union(low.filter("v != m").select("v", "m")).distinct())
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    return own.join(e, own["node"] == e["u"], "left").select("node", F.coalesce("v", "node").alias("root"))
