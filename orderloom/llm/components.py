"""Connected components of an edge table by alternating large and small stars.

Every round hangs the larger neighbours of each node below its smallest one and
then does the same for the smaller ones, until the edges are stars. Rounds are
stored in the shared folder, so a lost executor costs one round at most, and the
tables of smallest neighbours are joined by plain exchanges, which lets the
planner split a hub with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import stored

#: Rounds grow with the square of the logarithm of the nodes; so many are never needed.
_MOST_ROUNDS = 200


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges have a > b."""
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    others = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """id and component, the smallest id reachable, for every id that has an edge (columns a and b) to another.

    Edges may repeat and have either direction; nulls and loops count for nothing.
    """
    now = stored(_proper(edges), "edges")
    seen, state = None, _state(now)
    rounds = 0
    while state != seen and state[0]:
        if rounds == _MOST_ROUNDS:
            raise RuntimeError("the components of the edges did not settle")
        now = stored(_small_star(stored(_large_star(now), "large")), "stars")
        seen, state, rounds = state, _state(now), rounds + 1
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.union(now.select("b", "b").distinct())


def _proper(edges: DataFrame) -> DataFrame:
    """Each edge once, the larger end first."""
    return (
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
