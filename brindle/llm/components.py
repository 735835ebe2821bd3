"""Connected components by alternating large-star and small-star rounds.

Each round is two joins and two grouped minima over the remaining links; no
neighbour list is ever collected, so a node with a third of all links costs its
rows and nothing more. Links shrink to stars in a number of rounds that grows
with the logarithm of the size of a component. Every round ends in a reliable
checkpoint, so lineage stays one round deep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import checkpointed


def _star(links: DataFrame) -> DataFrame:
    """The least of every node ``u`` and its neighbours."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _round(links: DataFrame) -> DataFrame:
    both = _both(links)
    # large star: the larger neighbours of u move to the least of u and its neighbours
    large = (
        both.join(_star(both), "u")
        .where("v > u and v <> least")
        .select(F.col("v").alias("u"), F.col("least").alias("v"))
        .distinct()
    )
    # small star: the smaller neighbours of u, and u, move to the least of them
    least = _star(large)
    small = large.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return small.unionByName(least.select("u", F.col("least").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` for every node of ``links (u, v)``; root: the least node reachable.

    Loops, repeated links and nulls at either end are ignored. No links: no rows.
    """
    now = checkpointed(
        links.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = None
    for _ in range(most_rounds):
        now = checkpointed(_round(now))
        mark = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first()
        if mark == before:
            # stars only: every link ends in the root of its component
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = mark
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
