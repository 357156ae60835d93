"""Connected components by contraction: every round maps each node to its least neighbour,
follows those maps, and goes on with the edges between what remains.  All tables stay
distributed and each round's map is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges(a, b)`; component is the least node reachable.  Nulls are left out."""
    left = stored(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps = []
    while not left.isEmpty():
        # a < b: each node points to its least lower neighbour, if it has one
        up = stored(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")), "map")
        for _ in range(2):  # pointers are followed twice in a round
            hop = up.select(F.col("node").alias("mid"), F.col("to").alias("far"))
            up = stored(up.join(hop, F.col("to") == F.col("mid"), "left").select("node", F.coalesce("far", "to").alias("to")), "map")
        maps.append(up)
        ma = up.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        mb = up.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = left.join(ma, "a", "left").select(F.coalesce("ta", "a").alias("a"), "b").join(mb, "b", "left").select("a", F.coalesce("tb", "b").alias("b"))
        left = stored(moved.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = maps[-1]
    for m in reversed(maps[:-1]):
        later = found.select(F.col("node").alias("mid"), F.col("to").alias("far"))
        moved = m.join(later, F.col("to") == F.col("mid"), "left").select("node", F.coalesce("far", "to").alias("to"))
        found = stored(moved.unionByName(found.join(m.select("node"), "node", "left_anti").select("node", "to")), "map")
    roots = found.select(F.col("to").alias("node")).distinct().select("node", F.col("node").alias("to"))
    return stored(found.unionByName(roots.join(found.select("node"), "node", "left_anti")), "components").select("node", F.col("to").alias("component"))
