"""Connected components of an edge table by hooking and pointer jumping.

Every node points to its smallest neighbour, or to itself if none is smaller. Following pointers of
pointers leads each node to the root of its tree in a logarithmic number of joins. Edges between the
roots form a smaller graph, and the step repeats until no edge joins two trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.session import cut_lineage


def roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, root) whose pointers never go up; every root has its own row."""
    found = cut_lineage(parents)
    while True:
        above = found.select(F.col("node").alias("__node"), F.col("root").alias("__above"))
        jumped = cut_lineage(
            found.join(above, F.col("root") == F.col("__node"), "left").select(
                "node", F.coalesce("__above", "root").alias("root"),
                (F.coalesce("__above", "root") < F.col("root")).alias("__moved")))
        found = jumped.select("node", "root")
        if jumped.where("__moved").isEmpty():
            return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node of its component."""
    edges = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        hooked = roots(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")))
        if labels is None:
            labels = hooked
        else:
            step = hooked.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
            labels = cut_lineage(labels.join(step, F.col("root") == F.col("__node"), "left").select(
                "node", F.coalesce("__root", "root").alias("root")))
        left = hooked.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = hooked.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = cut_lineage(
            edges.join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if edges.isEmpty():
            return labels
