"""Connected components of any size by hooking and shortcutting of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import forget, stored


def components(edges: DataFrame) -> DataFrame:
    """(src, dst) edges in any direction to (node, component): the smallest id reachable.

    Ids without edges aren't returned. Each node points to a smaller one (up), and through it to that one's (top).
    In a round a node takes the least top of its neighbours, hands it on to the node that it points to, and
    points to its own top if that is less; so whole trees join, and rounds grow with the logarithm of the size in
    practice. Tables are stored each round, and both sides of joins on keys that may be hot are read from them, so
    AQE can split a hub's partition; the other steps are aggregates with a partial step first.
    """
    e = edges.where("src <> dst")
    both = e.select("src", "dst").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    loops = both.select("src", F.col("src").alias("dst"))
    pairs = stored(both.union(loops).distinct(), "edges")
    own = F.col("src") == F.col("dst")
    state = pairs.where(own).select(F.col("src").alias("node"), F.col("src").alias("up"), F.col("src").alias("top"))
    held: list[DataFrame] = []
    while True:
        # a node's own row is among its neighbours, by the loop
        near = pairs.join(state, pairs["dst"] == state["node"]).groupBy("src").agg(F.min("top").alias("least"), F.max(F.when(own, F.col("up"))).alias("up"), F.max(F.when(own, F.col("top"))).alias("top"))
        near = stored(near.withColumnRenamed("src", "node"), "near")
        hooked = near.groupBy(F.col("up").alias("root")).agg(F.min("least").alias("hook"))
        moved = near.join(hooked, near["node"] == hooked["root"], "left")
        moved = stored(moved.select("node", F.least("least", "up", "top", F.coalesce("hook", "up")).alias("up"), F.col("top").alias("had")), "moved")
        over = moved.select(F.col("node").alias("over"), F.col("up").alias("top"))
        state = stored(moved.join(over, moved["up"] == over["over"]).select("node", "up", F.least("up", "top").alias("top"), "had"), "labels")
        forget(near, moved, *held)
        held = [state]
        if state.where("top <> had").isEmpty():
            forget(pairs)
            return state.select("node", F.col("top").alias("component"))
