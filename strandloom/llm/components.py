"""Connected components by hooking and pointer jumping, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialised


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of the component of every node that has an edge (columns a, b).

    Every round lets each node, and its parent, adopt the smallest grandparent among its neighbours, so the depth of
    the graph halves about each time. Rounds end when no parent changes. Each round's table is written to the shared
    folder.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialised(both.where("a <> b").distinct())
    state = materialised(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("f")))
    while True:
        up = state.select(F.col("node").alias("p"), F.col("f").alias("gf"))
        full = materialised(state.join(up, state["f"] == up["p"]).select("node", "f", "gf"))
        heard = both.join(full.select(F.col("node").alias("b"), "gf"), "b").groupBy("a").agg(F.min("gf").alias("m"))
        near = full.join(heard, full["node"] == heard["a"], "left").select("node", "f", F.least("f", "gf", F.coalesce("m", "gf")).alias("m"))
        # A node's offer goes to itself and to its parent.
        offers = near.select("node", "m").unionByName(near.select(F.col("f").alias("node"), "m"))
        new = materialised(offers.groupBy("node").agg(F.min("m").alias("f")))
        old = state.select(F.col("node").alias("o_node"), F.col("f").alias("o_f"))
        changed = not new.join(old, (F.col("node") == F.col("o_node")) & (F.col("f") != F.col("o_f"))).isEmpty()
        drop_table(full)
        drop_table(state)
        state = new
        if not changed:
            drop_table(both)
            return state.select("node", F.col("f").alias("root"))
