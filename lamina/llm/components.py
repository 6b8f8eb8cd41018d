"""Connected components by alternating stars over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.skew import join_groups
from lamina.session import cut_lineage


def _star(neighbours: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them: those above the node, or the others and itself."""
    total = neighbours.count()
    least = neighbours.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    linked = join_groups(neighbours, least, ["u"], "n", total)
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node of it) for every node of ``edges`` (a, b).

    Every round is written to the checkpoint folder; nothing is collected but counts. Nodes without an
    edge to another node are not in the result.
    """
    now = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut_lineage(_star(both, large=True))
        small = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        now = cut_lineage(_star(small, large=False))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
