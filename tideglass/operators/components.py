"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.sources.scratch import discard, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component, the smallest node that can be reached, for every node of the edges a - b.

    Loops and repeated edges do no harm; edges with a null end are left out. Each half round is one grouped minimum, combined
    before the shuffle, and one join whose hot keys AQE splits, as both of its sides are plain tables. Rounds end when the set of
    edges, by count and checksum, stays as it is: all are stars then. Only those two numbers reach the driver.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    now = written(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    for _ in range(most_rounds):
        # large star: the larger neighbours of each node move to its smallest neighbour
        ends = now.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(now.select(F.col("b").alias("x"), F.col("a").alias("y")))
        least = written(ends.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
        large = written(ends.where("y > x").join(least, "x").select(F.col("y").alias("a"), F.col("m").alias("b")).distinct(), "large")
        discard(least, now)
        # small star: a node and its smaller neighbours move to the smallest of them
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(least, large)
        if (new := _state(now)) == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
