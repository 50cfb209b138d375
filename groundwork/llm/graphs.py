"""Connected components as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import copy, deal, hot_keys, join_groups
from .scratch import discard, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node that can be reached) for every node of the undirected ``edges``.

    Each round takes the smallest label among the neighbours and then follows that label once (pointer jumping),
    so the rounds grow with the logarithm of a component's diameter. Labels are written between rounds. Nodes with
    many neighbours and labels with many nodes are dealt or broadcast, so that neither lands in one task.
    """
    one, two = F.col(a).alias("a"), F.col(b).alias("b")
    both = edges.select(one, two).unionAll(edges.select(two.alias("a"), one.alias("b"))).filter("a <> b").distinct()
    both = written(both, "graph")
    hot = written(hot_keys(both, "b", both.count()), "graph-hot")
    dealt = written(deal(both, hot, "b", "a"), "graph-dealt")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    n_nodes = labels.count()
    while True:
        copies = copy(labels.select(F.col("node").alias("b"), "component"), hot, "b")
        near = dealt.join(copies, ["b", "_part"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        lower = written(lower, "lower")
        sizes = lower.groupBy("low").agg(F.count("*").alias("n"))
        up = sizes.join(labels.select(F.col("node").alias("low"), F.col("component").alias("up")), "low")
        after = join_groups(lower, up, "low", "n", n_nodes).select("node", F.least("low", "up").alias("component"), (F.least("low", "up") < F.col("old")).alias("moved"))
        after = written(after, "labels")
        moved = after.filter("moved").limit(1).count()
        discard(labels)
        discard(lower)
        labels = after
        if not moved:
            for done in (both, hot, dealt):
                discard(done)
            return labels.select("node", "component")
