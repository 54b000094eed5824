"""Connected components by passing the smallest label along links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.plans.staging import cut_lineage


def smallest_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) for every node that has a link: the smallest label in its component.

    ``nodes`` (node, label) have labels that no two of them share, apart from null; ``links`` (a, b) name nodes.  In
    each round a node takes the smallest label of its neighbours, then the label of the node that its label belongs
    to, so distances shrink by more than half.  Rounds are written tables; minima combine before the shuffle.
    """
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = cut_lineage(both.unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst"))))
    linked = both.select(F.col("src").alias("node")).distinct()
    state = cut_lineage(nodes.join(linked, "node").select("node", "label", F.col("label").alias("own")))
    while True:
        heard = both.join(state.select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node"))
        heard = heard.agg(F.min("label").alias("near"))
        near = state.join(heard, "node", "left").select("node", "own", "label", F.least("label", "near").alias("new"))
        near = cut_lineage(near)
        owner = near.select(F.col("own").alias("new"), F.col("new").alias("far"))
        jumped = near.join(owner, "new", "left").select(
            "node", F.least("new", "far").alias("label"), "own", (~F.least("new", "far").eqNullSafe(F.col("label"))).alias("moved")
        )
        state = cut_lineage(jumped)
        if state.filter("moved").isEmpty():
            return state.select("node", "label")
        state = state.drop("moved")
