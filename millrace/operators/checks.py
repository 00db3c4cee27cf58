"""Validators: each gives the rows or codes that break a rule, so that an empty result means it holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.cut import parts_for


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """code, n for each rule that some row breaks; a rule that is null counts as broken."""
    row = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(code) for code, rule in rules.items()])
    cells = F.array(*[F.struct(F.lit(code).alias("code"), F.col(code).alias("n")) for code in rules])
    return row.select(F.explode(cells).alias("c")).select("c.code", "c.n").filter("n > 0")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_parents(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Distinct child keys that no parent has.

    Both sides are counted and dealt by key into as many parts as that needs, so a task sorts no more for larger tables.
    """
    parts = parts_for(child.count() + parent.count())
    keys, known = (df.select(F.col(c).alias("key")).repartition(parts, "key") for df, c in ((child, key), (parent, parent_key)))
    return keys.distinct().join(known.hint("merge"), "key", "left_anti")


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side: keys that one side alone has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def artifact_difference(expected: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """key, status: same, stale, missing or extra, by digests; two null digests are the same."""
    there = F.lit(True)
    e = expected.select(key, F.col(digest).alias("__expected"), there.alias("__wanted"))
    f = found.select(key, F.col(digest).alias("__found"), there.alias("__there"))
    status = F.when(F.col("__there").isNull(), "missing").when(F.col("__wanted").isNull(), "extra")
    status = status.when(F.col("__expected").eqNullSafe(F.col("__found")), "same").otherwise("stale")
    return e.join(f, key, "full_outer").select(key, status.alias("status"))


def exact_schema(df: DataFrame, columns: dict[str, str]) -> None:
    """The columns and types that a table must have, no more and no fewer."""
    found = dict(df.dtypes)
    if found != columns:
        raise ValueError(f"columns differ: {sorted(set(found.items()) ^ set(columns.items()))}")


def exact_count(df: DataFrame, condition: Column, expected: int) -> DataFrame:
    """The rows that meet the condition; reading them fails unless there are `expected`."""
    chosen = df.filter(condition)
    n = chosen.agg(F.count(F.lit(1)).alias("__n"))
    checked = n.select(F.when(F.col("__n") == expected, F.lit(True)).otherwise(F.raise_error(F.lit(f"expected {expected} rows"))).alias("__ok"))
    return chosen.crossJoin(F.broadcast(checked)).filter("__ok").drop("__ok")


def array_contract(df: DataFrame, by: Sequence[str], column: str, size: int) -> DataFrame:
    """by, n, and how many arrays are missing or of another size, or hold a value that is no finite number."""
    x = lambda v: v.cast("double")
    odd = F.exists(column, lambda v: v.isNull() | F.isnan(x(v)) | (F.abs(x(v)) == float("inf")))
    wrong = F.coalesce(F.size(column), F.lit(-1)) != size
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("wrong_size"), F.count_if(odd).alias("not_finite"))
