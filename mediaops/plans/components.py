"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.plans.staging import cut_lineage


def connected(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, component): the smallest node that the edges (keys, a, b) lead to, for every node of an edge.

    Each round a node takes the least label around it and then that node's own label, so paths halve.  Minima are
    combined before the shuffle, and a hub is a key of an aggregate and never a group.
    """
    both = edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("next"))
    both = cut_lineage(both.unionByName(edges.select(*keys, F.col("b").alias("node"), F.col("a").alias("next"))).distinct())
    state = cut_lineage(both.groupBy(*keys, "node").agg(F.least(F.col("node"), F.min("next")).alias("component")))
    while True:
        around = both.join(state.withColumnRenamed("node", "next"), [*keys, "next"]).groupBy(*keys, "node").agg(F.min("component").alias("least"))
        heard = cut_lineage(state.join(around, [*keys, "node"]).select(*keys, "node", "component", F.least("component", "least").alias("new")))
        owner = heard.select(*keys, F.col("node").alias("new"), F.col("new").alias("far"))
        state = heard.join(owner, [*keys, "new"]).select(
            *keys, "node", F.least("new", "far").alias("component"), (F.least("new", "far") != F.col("component")).alias("moved")
        )
        state = cut_lineage(state)
        if state.filter("moved").isEmpty():
            return state.drop("moved")
        state = state.drop("moved")
