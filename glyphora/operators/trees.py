"""Trees of compositions and places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure(nodes: DataFrame, depth: int = 64) -> DataFrame:
    """nodes (id, parent) -> (id, ancestor), every node with itself and all above it.

    The paths double at each round, so a tree of depth d takes log2(d) joins; raises on a cycle deeper than `depth`.
    """
    up = nodes.where("parent is not null").select("id", F.col("parent").alias("ancestor"))
    found, step, reach = up, up, 1
    while reach < depth:
        # paths of up to `reach` steps, extended by those of exactly `reach`
        more = found.select("id", F.col("ancestor").alias("mid")).join(step.select(F.col("id").alias("mid"), "ancestor"), "mid").select("id", "ancestor")
        next_step = step.select("id", F.col("ancestor").alias("mid")).join(step.select(F.col("id").alias("mid"), "ancestor"), "mid").select("id", "ancestor")
        if next_step.isEmpty():
            found = found.unionByName(more)
            break
        found, step, reach = found.unionByName(more), next_step, 2 * reach
    else:
        raise ValueError(f"deeper than {depth}, or not a tree")
    return nodes.select("id", F.col("id").alias("ancestor")).unionByName(found).distinct()


def all_compositions(direct: DataFrame, nodes: DataFrame) -> DataFrame:
    """direct (text_id, id) -> (text_id, id): the compositions of a text and all above them."""
    return direct.distinct().join(closure(nodes), "id").select("text_id", F.col("ancestor").alias("id")).distinct()
