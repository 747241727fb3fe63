"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import materialise


#: Nodes with over one in this many of all rows are joined by broadcast; there are at most so many.
HUBS = 1000


def _with_least(pairs: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(pairs with m, the smallest neighbour v of u; the table (u, m) alone).

    Neighbours are combined before the shuffle.  The rows of a hub meet its m
    where they are, by a broadcast of at most ``HUBS`` rows; those of the other
    nodes are at most ``rows / HUBS`` each and meet it in a shuffle.
    """
    least = materialise(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    hubs = least.where(F.col("n") > rows // HUBS).select("u", F.col("m").alias("hub"))
    met = pairs.join(F.broadcast(hubs), "u", "left")
    others = met.where("hub is null").select("u", "v").join(least.where(F.col("n") <= rows // HUBS).select("u", "m"), "u")
    return met.where("hub is not null").select("u", "v", F.col("hub").alias("m")).unionByName(others), least.select("u", "m")


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    met, _ = _with_least(both, 2 * rows)
    return met.where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    met, root = _with_least(down, rows)
    return met.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(root.select(F.col("u").alias("a"), F.col("m").alias("b")))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long) that isn't the smallest of its component.

    Self loops, repeated edges and either direction are fine.  Steps are written
    to the shared folder, so no lineage builds up.  The number of rounds grows
    with the logarithm of the number of nodes.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    was = state(now)
    while was[0]:
        # a large star gives as many rows as there were edges
        now = materialise(_small_star(_large_star(now, was[0]), was[0]).where("a <> b").distinct(), "edges")
        if (got := state(now)) == was:
            break
        was = got
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
