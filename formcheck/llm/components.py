"""Connected components of a link table, by Spark jobs alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formcheck.llm.common import join_groups, materialise, release


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of links (a, b): the smallest node reachable.

    Each round takes the least label among the neighbours, then follows labels to their own label, so
    distances halve; it ends when no label changes. Nodes of many links and labels of many nodes are hot keys
    of the two joins and go by broadcast (at most a fixed number of them). Rounds are written to the shared folder."""
    both = materialise(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct(), "links")
    labels = materialise(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component"), F.count(F.lit(1)).alias("links")), "labels")
    edges, nodes = both.count(), labels.count()
    while True:
        # A node has as many links as it is the other end of.
        far = labels.select(F.col("node").alias("other"), F.col("component").alias("far"), "links")
        near = join_groups(both, far, ["other"], "links", total=edges).groupBy("node").agg(F.min("far").alias("far"))
        least = materialise(labels.join(near, "node").select("node", "component", "links", F.least("component", "far").alias("new")), "labels")
        sizes = least.groupBy("new").agg(F.count(F.lit(1)).alias("size"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("next")).join(sizes, "new")
        jumped = F.least("new", "next")
        moved = materialise(join_groups(least, jump, ["new"], "size", total=nodes).select("node", jumped.alias("component"), "links", (jumped < F.col("component")).alias("moved")), "labels")
        release(labels, least)
        labels = moved
        if not moved.where("moved").limit(1).count():
            release(both)
            return moved.select("node", "component")
