"""Connected components by alternating large-star and small-star rounds.

Each round replaces edges by edges to smaller neighbours until every node
points at its component's smallest one; rounds grow with the logarithm of the
largest component.  A hub's rows are pre-aggregated before the shuffle and
joined back by key, where adaptive execution can split them, so no group is
gathered anywhere.  Each round is written to the shared folder, and the round
before it deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.shared import drop, stored_at


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Every edge now points from a larger u to a smaller v.
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest node of the component of every node of (u, v).

    Nulls and loops are ignored; nodes without an edge do not appear.
    """
    last, path = stored_at(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        now, after = stored_at(_small_star(_large_star(last)), "stars")
        drop(edges.sparkSession, path)
        last, path = now, after
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        before = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
