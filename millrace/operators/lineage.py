"""Lineage graphs: rules for parents, levels and order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.cut import checkpointed


def lineage_problems(nodes: DataFrame, edges: DataFrame, rules: DataFrame, *, prefix: int | None = None) -> DataFrame:
    """code, subject for what is wrong. nodes: sha, kind. edges: child, parent, parent_kind. rules: kind, required, allowed (arrays).

    With prefix, different nodes whose first characters are the same collide where names are cut to so many.
    """
    twice = nodes.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("duplicate").alias("code"), F.col("sha").alias("subject"))
    kinds = nodes.select(F.col("sha").alias("parent"), F.col("kind").alias("real_kind"))
    found = edges.join(kinds, "parent", "left")
    missing = found.filter("real_kind is null").select(F.lit("missing_parent").alias("code"), F.col("child").alias("subject"))
    other = found.filter("real_kind <> parent_kind").select(F.lit("parent_kind").alias("code"), F.col("child").alias("subject"))
    seen = edges.groupBy(F.col("child").alias("sha")).agg(F.collect_set("parent_kind").alias("seen"))  # kinds are few
    judged = nodes.join(rules, "kind", "left").join(seen, "sha", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    lacking = judged.filter(F.size(F.array_except("required", "seen")) > 0).select(F.lit("lacks_parent").alias("code"), F.col("sha").alias("subject"))
    barred = judged.filter(F.size(F.array_except("seen", "allowed")) > 0).select(F.lit("barred_parent").alias("code"), F.col("sha").alias("subject"))
    unruled = judged.filter("required is null").select(F.lit("no_rule").alias("code"), F.col("sha").alias("subject"))
    out = twice
    if prefix:
        short = F.substring("sha", 1, prefix)
        same = nodes.groupBy(short.alias("subject")).agg(F.count_distinct("sha").alias("n")).filter("n > 1")
        out = out.unionByName(same.select(F.lit("prefix_collision").alias("code"), "subject"))
    for part in (missing, other, lacking, barred, unruled):
        out = out.unionByName(part)
    return out.distinct()


def levels(nodes: DataFrame, edges: DataFrame, *, node: str = "sha", most_rounds: int = 1000) -> DataFrame:
    """node, level: 0 without parents, else one more than the highest parent; null for nodes on or below a cycle.

    Each round settles the nodes all of whose parents are settled, and drops the edges from them: as many
    rounds as there are levels, each of which reads only what is still open and cuts its lineage. (level,
    node) is an order in which parents come first.
    """
    open_nodes = nodes.select(F.col(node).alias("node")).distinct()
    pending = checkpointed(edges.select("child", "parent").distinct())
    children = pending.select(F.col("child").alias("node")).distinct()
    fresh = checkpointed(open_nodes.join(children, "node", "left_anti").withColumn("level", F.lit(0)))
    settled = fresh
    for level in range(1, most_rounds):
        # What is left of the edges; the children that have none any more are settled.
        left = checkpointed(pending.join(fresh.select(F.col("node").alias("parent")), "parent", "left_anti"))
        waiting = left.select("child").distinct()
        fresh = pending.select("child").distinct().join(waiting, "child", "left_anti").select(F.col("child").alias("node"), F.lit(level).alias("level"))
        fresh, pending = checkpointed(fresh), left
        if fresh.isEmpty():
            break
        settled = settled.unionByName(fresh)
    return open_nodes.join(settled, "node", "left").select(F.col("node").alias(node), "level")
