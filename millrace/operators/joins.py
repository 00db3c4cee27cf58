"""Joins with a contract: complete or refused, nearest, overlaps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.cut import parts_for

#: Rows of a block of references, and of a part of the queries; with many features, the numbers in them.
BLOCK_ROWS, BLOCK_NUMBERS = 50_000, 500_000
#: Distances that a task holds at once.
DISTANCES = 500_000


def join_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, n_left, n_right, status for each key: matched, left_only, right_only or duplicate."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("n_right"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    status = F.when(F.col("n_right") == 0, "left_only").when(F.col("n_left") == 0, "right_only").when((F.col("n_left") > 1) | (F.col("n_right") > 1), "duplicate")
    return both.withColumn("status", status.otherwise("matched"))


def complete_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left and right on key, one to one; reading it fails at the first key that one side lacks or has twice."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(key))
    both = left.withColumn("__left", nth).join(right.withColumn("__right", nth), key, "full_outer")
    once = F.coalesce((F.col("__left") == 1) & (F.col("__right") == 1), F.lit(False))
    refused = F.raise_error(F.concat_ws(" ", F.lit("join is not complete: key"), F.col(key).cast("string"))).cast("boolean")
    return both.filter(F.when(once, F.lit(True)).otherwise(refused)).drop("__left", "__right")


def nearest(queries: DataFrame, references: DataFrame, key: str, features: Sequence[str], *, as_key: str = "nearest", exclude_self: bool = False) -> DataFrame:
    """key, nearest, distance2: for each query the reference of least squared distance, then least key.

    With exclude_self a query does not meet the references of its own key; null where no other is left.

    The queries are a stated set. References are dealt into blocks and queries into parts of BLOCK_ROWS
    rows at most and of BLOCK_NUMBERS numbers, by hash, equal rows once; each part meets each block in a task of
    its own, which holds the two and DISTANCES distances and gives each query's best, and the best of them stays.
    Nothing goes through the driver.
    """
    names = [f"f{i}" for i in range(len(features))]
    columns = [F.col(c).cast("double").alias(n) for c, n in zip(features, names, strict=True)]
    rows = queries.select(F.col(key).alias("q"), *columns).distinct()
    known = references.select(F.col(key).alias("r"), *columns).distinct()
    each = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(1, len(names))))
    blocks, parts = (parts_for(t.count(), each) for t in (known, rows))

    def dealt(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column, *names), F.lit(n).cast("long"))

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    asked = rows.withColumn("part", dealt("q", parts)).withColumn("block", all_of(blocks))
    met = known.withColumn("block", dealt("r", blocks)).withColumn("part", all_of(parts))

    def search(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        others = others.sort_values("r")
        keys, points, wanted = others["r"].to_numpy(), others[names].to_numpy(), some["q"].to_numpy()
        asked_for, norms, found = some[names].to_numpy(), (points**2).sum(axis=1), []
        step = max(1, DISTANCES // max(1, len(points)))
        for at in range(0, len(some) if len(points) else 0, step):
            x = asked_for[at : at + step]
            rough = (-2 * x) @ points.T
            rough += norms
            for i in range(len(x)):
                if exclude_self:
                    rough[i, keys == wanted[at + i]] = np.inf
                least = rough[i].min()
                if np.isinf(least):
                    continue
                # The product is rounded: the distance is taken anew where it could be the least.
                near = np.flatnonzero(rough[i] <= least + 1e-6 * (1 + norms.max()))
                exact = ((points[near] - x[i]) ** 2).sum(axis=1)
                j = int(np.argmin(exact))
                found.append((wanted[at + i], keys[near[j]], float(exact[j])))
        return pd.DataFrame(found, columns=["q", "r", "d"])

    types = (rows.schema["q"].dataType.simpleString(), known.schema["r"].dataType.simpleString())
    found = asked.groupBy("block", "part").cogroup(met.groupBy("block", "part")).applyInPandas(search, f"q {types[0]}, r {types[1]}, d double")
    best = found.groupBy("q").agg(F.min(F.struct("d", "r")).alias("b"))
    every = rows.select("q").distinct().join(best, "q", "left")
    return every.select(F.col("q").alias(key), F.col("b.r").alias(as_key), F.col("b.d").alias("distance2"))


def overlap_average(cells: DataFrame, axis: str, source: int, target: int, value: str, keys: Sequence[str]) -> DataFrame:
    """Average `source` unit cells along an axis into `target` equal bins, each cell by the part of it in the bin.

    A cell [i, i + 1) meets the bins that hold its ends and those between: told by arithmetic, so the
    interval join is an explode of a few bins a cell.
    """
    width = source / target
    first = F.floor(F.col(axis) * target / source)
    last = F.least(F.ceil((F.col(axis) + 1) * target / source) - 1, F.lit(target - 1))
    met = cells.withColumn("__bin", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    overlap = F.least(F.col(axis) + 1, (F.col("__bin") + 1) * width) - F.greatest(F.col(axis), F.col("__bin") * width)
    return met.groupBy(*keys, F.col("__bin").alias(axis)).agg((F.sum(F.col(value) * overlap) / width).alias(value))
