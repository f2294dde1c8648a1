"""Connected components of an undirected edge table, by alternating neighbour minimum and
pointer jumping. Everything stays distributed; each round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.plans.scratch import Scratch, small


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, label): for each node of an edge, the least node of its component.

    Self-loops give their node a row of its own; nulls are dropped. A round's cost is linear in
    the edges that still join different labels: edges are contracted to labels as it goes on, and
    repeated edges fall together, so a hub's edges thin out before they meet.
    """
    s = scratch or Scratch(edges.sparkSession)
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    e = s.table(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    # parent: node -> a node that is not larger, of the same component
    nodes = e.select(F.col("a").alias("node")).union(e.select("b"))
    label = s.table(nodes.groupBy("node").agg(F.min("node").alias("label")), "labels")
    live = e.where("a <> b")
    while not live.isEmpty():
        # each root that has a smaller neighbour hangs itself below the smallest
        hook = live.groupBy("b").agg(F.min("a").alias("to")).select(F.col("b").alias("root"), "to")
        hook = s.table(hook, "hooks")
        while True:  # pointer jumping: the hooks form a forest, its depth halves each time
            up = hook.select(F.col("root").alias("to"), F.col("to").alias("top"))
            jumped = hook.join(small(up), "to", "left").select("root", F.coalesce("top", "to").alias("to"), F.col("top").isNotNull().alias("moved"))
            jumped = s.table(jumped, "hooks")
            s.drop(hook)
            moved, hook = not jumped.where("moved").isEmpty(), jumped
            if not moved:
                break
        hook_s = small(hook.select("root", "to"))
        to = lambda c, out: (F.col(c) == F.col("root"), F.coalesce("to", c).alias(out))
        on, col = to("label", "label")
        label_2 = s.table(label.join(hook_s, on, "left").select("node", col), "labels")
        on, col = to("a", "a")
        left = live.join(hook_s, on, "left").select(col, "b")
        on, col = to("b", "b")
        left = left.join(hook_s, on, "left").select("a", col).where("a <> b")
        live_2 = s.table(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        s.drop(label, hook, e, live)
        label, live, e = label_2, live_2, live_2
    return label
