"""Connected components of a link table, by contraction.

Every round hooks each vertex to its smallest neighbour, follows these pointers to their roots by doubling, and replaces
the links by links between roots; rounds are logarithmic in the number of vertices, whatever the shape of the graph. All tables stay in
Spark; a vertex with very many links costs a map-side minimum and a join whose skewed side Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, label): label is the smallest node of the component; every node that has a link is there."""
    edges = materialize(links.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("parent")), "parent")
        while True:
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            jumped = materialize(parent.join(up, "parent").select("node", F.col("top").alias("parent"), (F.col("top") != F.col("parent")).alias("moved")), "parent")
            parent = jumped.select("node", "parent")
            if not jumped.where("moved").limit(1).count():
                break
        if labels is None:
            labels = parent.select("node", F.col("parent").alias("label"))
        else:
            moved = parent.select(F.col("node").alias("label"), F.col("parent").alias("to"))
            labels = materialize(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        a, b = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        edges = materialize(edges.join(a, "a").join(b, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    return labels
