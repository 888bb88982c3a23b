"""Connected components by contraction: hook every node to its least neighbour, follow the hooks
to their end, and go on with the edges between what is left. Rounds shrink by half or more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datarights.session import stage_unsized as cut


def _followed(hooks: DataFrame) -> DataFrame:
    """node -> end of its chain of hooks; hooks go to smaller nodes only, so chains end."""
    while True:
        onward = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
        stepped = cut(hooks.join(onward, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        hooks = stepped.select("node", "to")
        if stepped.where("moved").isEmpty():
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b) that is not its component's smallest; root is the smallest."""
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    while not edges.isEmpty():
        hooks = _followed(cut(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))))
        later = hooks.select(F.col("node").alias("root"), F.col("to").alias("new"))
        found = found.join(later, "root", "left").select("node", F.coalesce("new", "root").alias("root")).unionByName(hooks.select("node", F.col("to").alias("root")))
        found = cut(found)
        to_a, to_b = hooks.select(F.col("node").alias("a"), F.col("to").alias("na")), hooks.select(F.col("node").alias("b"), F.col("to").alias("nb"))
        moved = edges.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"))
        edges = cut(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return found
