"""Exact quantiles of any number of values, and joins on group keys that may be null.

An approximate sketch, merged before the shuffle, brackets each quantile of a large group; the rows below a
bracket are counted and only the values inside it are ranked. A bracket spans 6 / ACCURACY of the ranks
whatever the values are, so neither a large group nor an outlier gathers in a task, and no large group is
sorted whole. Equal values are counted before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.cut import checkpointed

#: The sketch is right to a rank of n / ACCURACY.
ACCURACY = 10_000
#: Groups of so many values are ranked without a bracket.
SMALL = 100_000
#: Groups whose brackets are sent to all tasks; more of them are joined by a shuffle.
MOST_SENT = 50_000


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys, null with null; the columns of both, keys once."""
    if not keys:
        return left.crossJoin(right)  # one row on the right: there are no keys
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def quantiles(df: DataFrame, by: Sequence[str], value: Column, names: dict[str, float], also: dict[str, Column] | None = None) -> DataFrame:
    """One row per group of df: by, a linearly interpolated quantile per name, and the aggregates of `also`.

    Nulls and NaN are no values; a group without values has null quantiles. df is read twice: give a
    checkpoint where it is costly. The groups' brackets are a checkpoint.
    """
    by, also = list(by), also or {}
    number = value.cast("double")
    rows = df.withColumn("__v", F.when(~F.isnan(number), number))
    margin = 3 / ACCURACY
    ends = [e for q in names.values() for e in (max(0.0, q - margin), min(1.0, q + margin))]
    sketch = rows.groupBy(*by).agg(
        F.count("__v").alias("__n"),
        F.percentile_approx("__v", F.array(*[F.lit(e) for e in ends]), F.lit(ACCURACY)).alias("__ends"),
        *[c.alias(n) for n, c in also.items()],
    )
    sketch = checkpointed(sketch)
    few = sketch.count() <= MOST_SENT
    brackets = sketch.select(*by, "__ends", "__n")
    there = matched(rows.select(*by, "__v").filter("__v is not null"), F.broadcast(brackets) if few else brackets, by)
    # Of each quantile a row's value if it is in the bracket, null if it lies below; of a small group each value once.
    cells = [F.when(F.col("__n") <= SMALL, F.struct(F.lit(-1).alias("i"), F.col("__v").alias("v")))]
    for i, q in enumerate(names.values()):
        low = F.lit(float("-inf")) if q - margin <= 0 else F.col("__ends")[2 * i]
        high = F.lit(float("inf")) if q + margin >= 1 else F.col("__ends")[2 * i + 1]
        inside = F.when(F.col("__v") >= low, F.col("__v"))
        cells.append(F.when((F.col("__n") > SMALL) & (F.col("__v") <= high), F.struct(F.lit(i).alias("i"), inside.alias("v"))))
    met = there.select(*by, F.explode(F.array(*cells)).alias("c")).filter("c is not null")
    counted = met.groupBy(*by, F.col("c.i").alias("__i"), F.col("c.v").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    running = F.sum("__c").over(Window.partitionBy(*by, "__i").orderBy(F.asc_nulls_first("__v")).rowsBetween(Window.unboundedPreceding, 0))
    sized = sketch.select(*by, "__n")
    placed = matched(counted.withColumn("__end", running), F.broadcast(sized) if few else sized, by)
    ranks = {name: F.lit(float(q)) * (F.col("__n") - 1) for name, q in names.items()}

    def at(i: int, rank: Column) -> Column:
        own = F.col("__i").isin(-1, i) & (F.col("__end") - F.col("__c") <= rank) & (rank < F.col("__end"))
        return F.max(F.when(own, F.col("__v")))

    picked = [c for i, (k, r) in enumerate(ranks.items()) for c in (at(i, F.floor(r)).alias(f"__lo_{k}"), at(i, F.ceil(r)).alias(f"__hi_{k}"))]
    found = placed.groupBy(*by).agg(F.max("__n").alias("__n"), *picked)
    missed = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")

    def between(name: str) -> Column:
        low, high, rank = F.coalesce(f"__lo_{name}", missed), F.coalesce(f"__hi_{name}", missed), ranks[name]
        # Equal ends are told as they are: infinities have no difference.
        return F.when(F.col("__n") > 0, F.when(low == high, low).otherwise(low + (rank - F.floor(rank)) * (high - low)))

    said = found.select(*by, *[between(name).alias(name) for name in names])
    kept = sketch.select(*by, *also)
    return matched(kept, said, by, "left") if by else _one_row(kept, said)


def _one_row(kept: DataFrame, said: DataFrame) -> DataFrame:
    """Without keys both sides have one row or none."""
    return kept.join(said, F.lit(True), "left")
