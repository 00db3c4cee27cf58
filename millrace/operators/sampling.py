"""Splits, probes, epoch orders and batches by hash rank; stratified designs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalar import affine, hash_rank
from millrace.operators.cut import checkpointed
from millrace.operators.quantiles import matched

#: Rows are ranked inside ranges of their digest's first two bytes, which get offsets: no single task ranks all rows.
PREFIX = 4
MOST_LEVELS = 1000
#: Points of a block whose distances give a bound, and features that make the cells of the grid.
BLOCK_POINTS, GRID_FEATURES = 32, 3


def ranked(df: DataFrame, digest: Column, *keys: str) -> DataFrame:
    """df with place: 0 for the least (digest, keys), counted over the whole table without one global sort."""
    rows = df.withColumn("__digest", digest).withColumn("__prefix", F.substring("__digest", 1, PREFIX))
    before = F.sum("__in").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy(F.col("__prefix").alias("__p")).agg(F.count(F.lit(1)).alias("__in"))  # 16 ** PREFIX rows at most
    offsets = counts.select("__p", F.coalesce(before, F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__prefix").orderBy("__digest", *keys)) - 1
    placed = rows.join(offsets, F.col("__prefix") == F.col("__p"))
    return placed.withColumn("place", (F.col("__before") + inner).cast("long")).drop("__digest", "__prefix", "__p", "__before")


def hash_split(df: DataFrame, salt: str, key: str, shares: dict[str, float]) -> DataFrame:
    """df with split: the first share of the hash order, then the next; sizes are exact up to rounding down, the last takes the rest."""
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    rows = ranked(df, hash_rank(salt, F.col(key)), key).crossJoin(F.broadcast(total))
    names, bound, split = list(shares), 0.0, None
    for name in names[:-1]:
        bound += shares[name]
        inside = F.col("place") < F.floor(F.col("__n") * bound)
        split = F.when(inside, name) if split is None else split.when(inside, name)
    return rows.withColumn("split", split.otherwise(names[-1]) if split is not None else F.lit(names[0])).drop("place", "__n")


def hash_top(df: DataFrame, salt: str, key: str, n: int) -> DataFrame:
    """The n rows of least digest."""
    return df.withColumn("digest", hash_rank(salt, F.col(key))).orderBy("digest", key).limit(n)


def epoch_batches(df: DataFrame, dataset: str, seed: int, epoch: int, key: str, size: int) -> DataFrame:
    """df with place (the epoch's order) and batch; the last batch may be short."""
    rows = ranked(df, hash_rank(f"{dataset}|{seed}|{epoch}", F.col(key)), key)
    return rows.withColumn("batch", F.floor(F.col("place") / size).cast("long"))


def stratified_design(spark, n: int, ranges: dict[str, tuple[float, float]], salt: str) -> DataFrame:
    """index and one value per dimension: each dimension has one point in the middle of each of n strata, in hash order."""
    rows = spark.range(n).withColumnRenamed("id", "index")
    for name, (low, high) in ranges.items():
        placed = ranked(rows, hash_rank(f"{salt}|{name}", F.col("index")), "index")
        rows = placed.withColumn(name, affine((F.col("place") + 0.5) / n, low, high)).drop("place")
    return rows


def probe_grid(items: DataFrame, *others: DataFrame) -> DataFrame:
    """Every combination of a few stated levels with every item: levels are tables of at most MOST_LEVELS settings."""
    out = items
    for levels in others:
        if levels.limit(MOST_LEVELS + 1).count() > MOST_LEVELS:
            raise ValueError(f"a table of levels has more than {MOST_LEVELS} rows")
        out = out.crossJoin(F.broadcast(levels))
    return out


def closest_pairs(points: DataFrame, group: str, key: str, features: Sequence[str]) -> DataFrame:
    """group, least_distance2: the square of the least distance between two points of each group; null without two.

    Points are dealt at random into blocks of BLOCK_POINTS, and the least distance d within them is a bound that about
    n / BLOCK_POINTS pairs lie under, whatever the points are. In cells of side d (of the first GRID_FEATURES features)
    only points of neighbouring cells can be nearer, and few share one. A point whose features aren't all numbers has no
    distance.
    """
    rows = points.select(F.col(group).alias("g"), F.col(key).alias("i"), *[F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)])
    names = [f"x{k}" for k in range(len(features))]
    whole = rows.filter(F.greatest(*[F.abs(n) for n in names], F.lit(0.0)) < float("inf")) if names else rows
    for n in names:
        whole = whole.filter(F.col(n).isNotNull() & ~F.isnan(n))
    # A number of its own tells apart points that share a key.
    whole = checkpointed(whole.withColumn("o", F.monotonically_increasing_id()))
    sizes = whole.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK_POINTS).alias("blocks"))
    dealt = matched(whole, sizes, ["g"]).withColumn("b", F.pmod(F.xxhash64("o"), F.col("blocks"))).drop("blocks")
    bound = checkpointed(_least(dealt, dealt, ["g", "b"], names))
    near = matched(whole, bound.filter("d2 > 0"), ["g"]).withColumn("side", F.sqrt("d2"))
    grid = names[:GRID_FEATURES]
    cell = [F.floor(F.least(F.greatest(F.col(n) / F.col("side"), F.lit(-4e18)), F.lit(4e18))).alias(f"c{n}") for n in grid]
    placed = near.select("g", "o", *names, *cell)
    around = placed
    for n in grid:
        around = around.withColumn(f"c{n}", F.explode(F.array(*[F.col(f"c{n}") + s for s in (-1, 0, 1)])))
    nearer = _least(around, placed, ["g", *[f"c{n}" for n in grid]], names)
    both = bound.unionByName(nearer).groupBy("g").agg(F.min("d2").alias("d2"))
    every = rows.select("g").distinct()
    return matched(every, both, ["g"], "left").select(F.col("g").alias(group), F.col("d2").alias("least_distance2"))


def _least(left: DataFrame, right: DataFrame, on: Sequence[str], names: Sequence[str]) -> DataFrame:
    """g, d2: the least squared distance between two points that share `on`."""
    other = right.select(*[F.col(c).alias(f"{c}__r") for c in [*on, "o", *names]])
    same = [left[c].eqNullSafe(other[f"{c}__r"]) for c in on]
    pairs = left.join(other, [*same, left["o"] < other["o__r"]])
    return pairs.groupBy("g").agg(F.min(sum(((F.col(n) - F.col(f"{n}__r")) ** 2 for n in names), F.lit(0.0))).alias("d2"))


def maximin(points: DataFrame, candidate: str, key: str, features: Sequence[str]) -> DataFrame:
    """candidate, least_distance2 and chosen: of candidate designs the one whose two closest points lie furthest apart.

    Ties go to the lowest candidate; a design of one point has no distance and is not chosen.
    """
    least = checkpointed(closest_pairs(points, candidate, key, features))
    best = least.filter("least_distance2 is not null").agg(F.max_by(candidate, F.struct("least_distance2", -F.col(candidate))).alias("__best"))
    return least.crossJoin(F.broadcast(best)).withColumn("chosen", F.coalesce(F.col(candidate) == F.col("__best"), F.lit(False))).drop("__best")  # one row
