"""Connected components by distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as (a bigint, b bigint).

    Result: (node, label), one row per node that occurs in an edge; the label is the smallest node of
    the component. Loops, repeated and reversed edges are harmless, edges with a null end are dropped.
    Every round replaces a node's label by the smallest of its neighbours' labels and then by that
    label's own label, so the number of rounds grows with the logarithm of a component's diameter.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null and a != b")
    e = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    loops = edges.select(F.explode(F.array(F.col("a").cast("long"), F.col("b").cast("long"))).alias("node")).filter("node is not null").distinct()
    labels = materialize(loops.join(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")), "node", "left").select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(max_rounds):
        near = e.join(labels, e["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", "label", F.least("label", "m").alias("n"))
        parent = labels.select(F.col("node").alias("p"), F.col("label").alias("pl"))
        jumped = step.join(parent, step["n"] == parent["p"], "left").select("node", F.col("label").alias("old"), F.least("n", "pl").alias("label"))
        nxt = materialize(jumped, "labels")
        changed = nxt.filter("old != label").limit(1).count()
        labels = nxt.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
