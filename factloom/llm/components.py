"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Every step sends each node's neighbours to the least label around it; the two steps converge in a
logarithmic number of rounds to one star for each component. Edges stay in written tables of the shared
folder; the driver sees only a count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import stash, unstash


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours. The minimum is combined before the shuffle; a hot u is a skewed join."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = least.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b; longs): component is the least node reachable.

    Self edges count as nodes without other links only if they have one; an empty list gives an empty table.
    """
    now = stash(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == (mark["n"], mark["h"]) or not mark["n"]:
            break
        seen = (mark["n"], mark["h"])
        after = stash(_small_star(_large_star(now)), "edges")
        unstash(now)
        now = after
    else:
        raise RuntimeError("components did not converge")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
