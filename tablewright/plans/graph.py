"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.plans.durable import durable
from tablewright.plans.ordered import join_back


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the undirected edges (a, b).

    Every round takes the smallest root among the neighbours and then the root of that root, so long chains
    shrink geometrically.  Degrees are bounded by the grid; the many nodes under one root are joined hot-key safe.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = durable(both)
    state = durable(nodes.select("node", F.col("node").alias("root")))
    while True:
        offered = both.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("best"))
        stepped = durable(
            state.join(offered, "node", "left").select("node", "root", F.least("root", F.coalesce("best", "root")).alias("new"))
        )
        weights = stepped.groupBy(F.col("new")).agg(F.count("*").alias("n"))
        roots = weights.join(stepped.select(F.col("node").alias("new"), F.col("new").alias("top")), "new")
        jumped = durable(join_back(stepped, roots, ["new"], "n").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
        state = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return state
