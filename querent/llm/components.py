"""Connected components of an edge table by random contraction, all in DataFrame joins.

Each round every vertex moves to the least of itself and its neighbours, in an order drawn anew,
and edges follow. Rounds shrink the graph by a constant factor on average, chains included. Both
tables are checkpointed each round, so a lost executor costs no more than one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``vertex, root`` of all vertices of ``a, b`` (64-bit integers); equal root, same component.

    Loops and repeated edges are fine; nulls are dropped; vertices without edges don't appear."""
    edges = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna().filter("a <> b").distinct())
    labels = None
    turn = 0
    while edges.count():
        order = lambda c, t=turn: F.struct(F.xxhash64(F.col(c), F.lit(t)), F.col(c).alias("v"))
        both = edges.union(edges.select("b", "a"))
        moved = cut(
            both.groupBy(F.col("a").alias("u"))
            .agg(F.min(order("b")).alias("m"), F.min(order("a")).alias("own"))
            .select("u", F.least("m", "own")["v"].alias("to"))
        )
        if labels is None:
            labels = moved.select(F.col("u").alias("vertex"), F.col("to").alias("root"))
        else:
            labels = cut(labels.join(moved, labels.root == moved.u, "left").select("vertex", F.coalesce("to", "root").alias("root")))
        edges = cut(
            edges.join(moved.select(F.col("u").alias("a"), F.col("to").alias("x")), "a")
            .join(moved.select(F.col("u").alias("b"), F.col("to").alias("y")), "b")
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        turn += 1
    return labels if labels is not None else edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
