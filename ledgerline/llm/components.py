"""Connected components of an undirected graph, with DataFrame joins.

Each round a node takes the least label among its own and its neighbours', and then its label's
label (pointer jumping), so long chains shorten by half; rounds go on until no label changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Rows of links or labels a partition; they are narrow, and each round is a few joins.
ROWS = 100_000


def _few(df: DataFrame, rows: int) -> DataFrame:
    return df.coalesce(max(1, rows // ROWS))


def climb(parents: DataFrame) -> DataFrame:
    """node, label of a forest; parents: a, b, where b is a's parent.  The label is the tree's root.

    Each round a node's label becomes its label's label.
    """
    labels = cut(parents.select(F.col("a").alias("node"), F.col("b").alias("label")))
    rows = labels.count()
    while True:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = labels.join(up, "label", "left").select("node", F.coalesce("further", "label").alias("label"), F.col("further").isNotNull().alias("moved"))
        labels = cut(_few(new, rows))
        if labels.where("moved").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def label(edges: DataFrame) -> DataFrame:
    """node, label for each node that has an edge; edges: a, b.  A label is the component's least node."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    rows = both.count()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label"))
    labels = cut(_few(labels, rows))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = new.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = new.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old")
        new = cut(_few(new, rows))
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
