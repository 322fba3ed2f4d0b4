"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (combined map-side) and a join of the edges to it. The edges of a hub, a node with a large share of
all edges, join where they are: minima of hubs are broadcast, and there are at most HUBS of them, whatever the data. So no task holds all edges
of a hub, nothing is gathered per node, and nothing goes to the driver but two totals per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphora.llm._common import drop_written, written


#: Hubs of a step at most, and edges that a node must have to be one.
HUBS, LEAST = 10_000, 64


def _with_least(edges: DataFrame, n: int, least: DataFrame) -> DataFrame:
    """edges (u, v), n of them, and least (u, m, n) -> u, v, m."""
    hub = F.col("n") > max(LEAST, n // HUBS)  # fewer than HUBS nodes can have that many
    few = least.where(hub).select("u", "m")
    rest = edges.join(F.broadcast(few), "u", "left_anti").join(least.where(~hub).select("u", "m"), "u")
    return edges.join(F.broadcast(few), "u").unionByName(rest)


def _least(edges: DataFrame) -> DataFrame:
    return written(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")


def _round(now: DataFrame, n: int) -> DataFrame:
    """A large-star and a small-star step; edges have u > v before and after."""
    both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    large = written(_with_least(both, 2 * n, least).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")), "large")
    down = _least(large)
    hung = _with_least(large, n, down).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    after = written(hung.union(down.select("u", "m")).distinct(), "cc")
    for done in (now, least, large, down):
        drop_written(done)
    return after


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u long, v long), in any direction, repeats and loops allowed -> (node, root): every node of an
    edge that isn't its own root, with the smallest node that it reaches. A node missing there is its own root.

    Raises if `rounds` do not suffice (each round at least halves the depth of what is left).
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = total(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        now, before = _round(now, seen[0]), seen
        seen = total(now)
        if tuple(before) == tuple(seen):
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
