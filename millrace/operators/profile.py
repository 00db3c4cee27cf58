"""Profiles, distributions, correlations and summaries that fail closed."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalar import finite
from millrace.operators.cut import checkpointed
from millrace.operators.quantiles import ACCURACY, matched, quantiles


def long_form(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, column, value: one row for each cell."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.explode(cells).alias("cell")).select(*keys, "cell.column", "cell.value")


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n, n_null, minimum, maximum, mean, std (population), q05, q50, q95; nulls where all is null."""
    cells = long_form(df, columns)
    plain = {
        "n": F.count(F.lit(1)),
        "n_null": F.count_if(F.col("value").isNull()),
        "minimum": F.min("value"),
        "maximum": F.max("value"),
        "mean": F.avg("value"),
        "std": F.stddev_pop("value"),
    }
    return quantiles(cells, ["column"], F.col("value"), {"q05": 0.05, "q50": 0.5, "q95": 0.95}, plain)


def distribution(df: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    plain = {"n": F.count(F.lit(1)), "minimum": F.min(value), "maximum": F.max(value), "mean": F.avg(value)}
    return quantiles(df, by, value, {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}, plain)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r for every pair of columns, in one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(cells).alias("c")).select("c.a", "c.b", "c.r")


def summarise_closed(df: DataFrame, by: Sequence[str], value: Column, valid: Column) -> DataFrame:
    """Counts and median, p90, p95, maximum of a metric; one invalid member makes a group invalid, with null statistics."""
    by = list(by)
    good = F.coalesce(valid & finite(value), F.lit(False))
    rows = df.select(*by, F.when(good, value.cast("double")).alias("__value"))
    counts = {"n": F.count(F.lit(1)), "n_valid": F.count("__value"), "maximum": F.max("__value")}
    said = quantiles(rows, by, F.col("__value"), {"median": 0.5, "p90": 0.9, "p95": 0.95}, counts)
    whole = (F.col("n") == F.col("n_valid")) & F.col("median").isNotNull()
    stats = [F.when(whole, F.col(c)).alias(c) for c in ("median", "p90", "p95", "maximum")]
    return said.select(*by, "n", "n_valid", *stats, F.when(whole, "valid").otherwise("invalid").alias("status"))


def worst(df: DataFrame, by: Sequence[str], value: str, key: str, most: int = 20) -> DataFrame:
    """The rows of greatest value, then least key, of each group, with their place."""
    order = [F.desc(value), F.asc(key)]
    if not by:
        top = df.orderBy(*order).limit(most)
        return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= most)


def told(df: DataFrame, column: str) -> Column:
    """Whether a column says a value: it is neither null nor NaN."""
    value = F.col(f"`{column}`")
    return value.isNotNull() & ~F.isnan(value) if dict(df.dtypes)[column] in ("double", "float") else value.isNotNull()


def representative_and_extreme(df: DataFrame, by: Sequence[str], value: str, key: str) -> DataFrame:
    """Each group's median, the key nearest to it and the key of the greatest value; ties go to the least key.

    Rows without a value (null or NaN) are neither; a group of such rows has nulls.
    """
    by = list(by)
    shape = quantiles(df, by, F.col(value), {"median": 0.5})
    rows = matched(df, shape, by)
    some = told(df, value)
    distance = F.when(some, F.struct(F.abs(F.col(value) - F.col("median")), F.col(key)))
    return rows.groupBy(*by).agg(
        F.first("median").alias("median"),
        F.min_by(key, distance).alias("representative"),
        F.min_by(key, F.when(some, F.struct(-F.col(value), F.col(key)))).alias("extreme"),
    )


def best_of(df: DataFrame, by: Sequence[str], score: str, tie: str) -> DataFrame:
    """The row of least score, then least tie, of each group; aggregated without sorting groups.

    A null or NaN score never wins; a group without any other has nulls.
    """
    others = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.min_by(F.struct(*others), F.when(told(df, score), F.struct(score, tie))).alias("__best"))
    return best.select(*by, "__best.*")


#: Of a resample of n values the median lies so near to that of all: eight standard deviations, and the sketch's error.
_MARGINS = [0.5, 0.2, 0.06, 0.02, 0.006, 0.002, 0.0008]
#: Poisson's law with mean 1 on 32 bits: the weight is the number of these that the bits reach.
POISSON = [int(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]


def resample_weights(seed: int, key: Column, resamples: int) -> Column:
    """How often a row is drawn into each resample: array of `resamples` numbers, from a digest of (seed, key, four resamples)."""

    def four(q: Column) -> Column:
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), q.cast("string")))
        bits = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
        return F.transform(bits, lambda b: sum((F.when(b >= t, 1).otherwise(0) for t in POISSON[1:]), F.when(b >= POISSON[0], 1).otherwise(0)))

    return F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit((resamples - 1) // 4)), four)), 1, resamples)


def bootstrap_median(df: DataFrame, by: Sequence[str], value: Column, key: Column | None = None, *, resamples: int = 1000, seed: int = 17) -> DataFrame:
    """by, n, low, high: the 2.5 % and 97.5 % quantiles of the median of resamples.

    In each resample a row counts as often as a Poisson weight says that follows from the seed, its key and the
    resample, so resamples need no group in a task: weights below a bracket around the median are summed before the
    shuffle, and only the values in it, fewer the larger a group is, are ranked. Rows without a value (null or NaN)
    are left out; a group without values has nulls. Rows of one key share their weights; without a key, equal rows do.
    """
    by = list(by)
    number = value.cast("double")
    rows = df.select(*by, F.when(~F.isnan(number), number).alias("v"), (F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) if key is None else key).alias("k"))
    ends = [q for m in _MARGINS for q in (0.5 - m, 0.5 + m)]
    shape = checkpointed(rows.groupBy(*by).agg(F.count("v").alias("n"), F.percentile_approx("v", F.array(*[F.lit(e) for e in ends]), F.lit(ACCURACY)).alias("e")))
    wanted, low, high = 4 / F.sqrt(F.greatest(F.col("n"), F.lit(1))) + 2 / ACCURACY, F.lit(float("-inf")), F.lit(float("inf"))
    for i, m in enumerate(_MARGINS[1:], start=1):
        fits = wanted <= m
        low, high = F.when(fits, F.col("e")[2 * i]).otherwise(low), F.when(fits, F.col("e")[2 * i + 1]).otherwise(high)
    bracket = shape.select(*by, "n", low.alias("low"), high.alias("high"))
    met = matched(rows.filter("v is not null"), bracket, by)
    # Of a bracket's values each; null stands for all below, infinity for all above.
    place = F.when(F.col("v") < F.col("low"), F.lit(None)).when(F.col("v") > F.col("high"), float("inf")).otherwise(F.col("v"))
    drawn = met.select(*by, place.alias("v"), F.posexplode(resample_weights(seed, F.col("k"), resamples)).alias("r", "w")).filter("w > 0")
    sums = drawn.groupBy(*by, "r", "v").agg(F.sum("w").alias("w"))
    each = Window.partitionBy(*by, "r")
    running = sums.select(*by, "r", "v", "w", F.sum("w").over(each.orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)).alias("end"), F.sum("w").over(each).alias("all"))

    def at(rank: Column) -> Column:
        own = (F.col("end") - F.col("w") <= rank) & (rank < F.col("end"))
        missed = F.raise_error(F.lit("a median lies outside its bracket")).cast("double")
        return F.max(F.when(own, F.when(F.col("v").isNull() | (F.col("v") == float("inf")), missed).otherwise(F.col("v"))))

    medians = running.groupBy(*by, "r").agg(((at(F.floor((F.col("all") - 1) / 2)) + at(F.floor(F.col("all") / 2))) / 2).alias("m"))
    # One value for each resample.
    said = medians.groupBy(*by).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return matched(shape.select(*by, "n"), said, by, "left").select(*by, "n", "low", "high")
