"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round keeps the components and brings every node nearer to its least one; stars are the fixed
point. Only minima are aggregated, so a node with a very large number of neighbours is combined before
the shuffle, and the joins that follow are of the kind that adaptive execution splits. Rounds grow with
the logarithm of the longest path. Each round's edges are a written table, which goes once the next is
there: nothing is collected. What a round wrote is counted and added up while it is written, so a round is one
query; a task that ran twice may change the sum, which costs a round more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.llm.common import durable, forget


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, and their number with the sum of their hashes."""
    seen = Observation()
    sums = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hashes")
    table = durable(edges.observe(seen, *sums), "edges")
    return table, (seen.get.get("n"), seen.get.get("hashes"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).distinct()


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """edges: a, b (any order; loops are ignored). Returns node, component: the least node that it reaches."""
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, said = _written(now)
    for _ in range(most_rounds):
        if not said[0]:
            break
        last, before = now, said
        now, said = _written(_small_star(_large_star(last)))
        forget(last)
        if said == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
