"""Evidence: agreement and coverage between tables, rollup digests, guarded means, retention, pointers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.cut import parts_for
from millrace.operators.profile import told
from millrace.operators.quantiles import matched


def agreement(manifest: DataFrame, runs: DataFrame, key: str, rules: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """column, compared, differ: over the keys that both have, how many pairs break a column's rule; null breaks it."""
    both = manifest.alias("m").join(runs.alias("r"), key)
    counts = [F.count_if(~F.coalesce(rule(F.col(f"m.{c}"), F.col(f"r.{c}")), F.lit(False))).alias(c) for c, rule in rules.items()]
    row = both.agg(F.count(F.lit(1)).alias("__all"), *counts)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col("__all").alias("compared"), F.col(c).alias("differ")) for c in rules])
    return row.select(F.explode(cells).alias("c")).select("c.column", "c.compared", "c.differ")


def identities(rows: DataFrame, known: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """rows with status: the first of (reason, column, table of one column) whose table does not hold the row's value, else 'known'.

    Rows are counted and dealt anew for each table, into as many parts as both need, so a task sorts no more for larger tables.
    """
    out, status, n = rows, None, rows.count()
    for i, (reason, column, table) in enumerate(known):
        parts = parts_for(n + table.count())
        there = table.select(F.col(table.columns[0]).alias(f"__k{i}")).repartition(parts, f"__k{i}").distinct().withColumn(f"__there{i}", F.lit(True))
        out = out.repartition(parts, column).join(there.hint("merge"), F.col(column) == F.col(f"__k{i}"), "left")
        lacks = F.col(f"__there{i}").isNull()
        status = F.when(lacks, reason) if status is None else status.when(lacks, reason)
    return out.withColumn("status", status.otherwise("known")).select(*rows.columns, "status")


def coverage(said: DataFrame, cases: DataFrame, predictor: str, key: str) -> DataFrame:
    """Of each predictor: cases wanted, missing, extra, and those that it speaks of more than once."""
    n = said.groupBy(predictor, key).agg(F.count(F.lit(1)).alias("__n"))
    wanted = cases.select(key).distinct()
    total = wanted.agg(F.count(F.lit(1)).alias("wanted"))
    found = n.join(wanted.withColumn("__wanted", F.lit(True)), key, "left").groupBy(predictor).agg(
        F.count("__wanted").alias("__met"), F.count_if(F.col("__wanted").isNull()).alias("extra"), F.count_if(F.col("__n") > 1).alias("repeated")
    )
    return found.crossJoin(F.broadcast(total)).select(predictor, "wanted", (F.col("wanted") - F.col("__met")).alias("missing"), "extra", "repeated")  # one row


#: Digests that make one of the next level, and how many levels there are above the stretches.
FAN, LEVELS = 1000, 2


def rollup_digest(rows: DataFrame, by: Sequence[str], stretch: Column, order: Sequence[str], digest: str) -> DataFrame:
    """by, n, digest of each group's rows in order; stretch is a whole number that grows with the order.

    The digests of a stretch's rows make the stretch's digest, those of FAN stretches the next one's, and
    those at the top the group's: a task holds one stretch or FAN digests, and the result does not depend on
    how the rows were partitioned.
    """
    by = list(by)

    def joined(pairs: Column, between: str, said: Callable[[Column], Column]) -> Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(pairs), said), between), 256)

    row = F.struct(*order, digest)
    level = rows.withColumn("__part", stretch.cast("long")).groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("n"), joined(F.collect_list(row), "", lambda r: r[digest]).alias("digest"))
    pair = F.struct("__part", "digest")
    merged = [F.sum("n").alias("n"), joined(F.collect_list(pair), ",", lambda p: F.concat_ws(":", p["__part"], p["digest"])).alias("digest")]
    for _ in range(LEVELS - 1):
        level = level.groupBy(*by, F.floor(F.col("__part") / FAN).alias("__next")).agg(*merged).withColumnRenamed("__next", "__part")
    return level.groupBy(*by).agg(*merged)


def weighted_means(df: DataFrame, by: Sequence[str], columns: Sequence[str], weight: str, digits: int) -> DataFrame:
    """by, n and the mean of each column weighted by `weight`; both are read as decimals of so many digits, whose sums are exact."""
    exact = f"decimal(18,{digits})"
    w = F.col(weight).cast(exact)
    means = [(F.sum(w * F.col(c).cast(exact)).cast("double") / F.sum(F.when(F.col(c).isNotNull(), w)).cast("double")).alias(c) for c in columns]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *means)


def share_passing(df: DataFrame, by: Sequence[str], passes: Column, valid: Column) -> DataFrame:
    """by, n, the share of rows that pass, status; one row that is not valid leaves no share."""
    said = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(valid, F.lit(False))).alias("__valid"), F.avg(F.coalesce(passes, F.lit(False)).cast("double")).alias("share"))
    whole = F.col("n") == F.col("__valid")
    return said.select(*by, "n", F.when(whole, F.col("share")).alias("share"), F.when(whole, "valid").otherwise("invalid").alias("status"))


def error_grid(cells: DataFrame, value: str, reference: str) -> DataFrame:
    """cells with error, and the greatest size of either field and of the errors over all cells."""
    x, y = F.col(value), F.col(reference)
    scales = cells.agg(F.max(F.greatest(F.abs(x), F.abs(y))).alias("field_scale"), F.greatest(F.max(F.abs(x - y)), F.lit(1e-12)).alias("error_scale"))
    return cells.withColumn("error", F.abs(x - y)).crossJoin(F.broadcast(scales))  # one row


def newest(df: DataFrame, by: Sequence[str], at: str, key: str, most: int) -> DataFrame:
    """df with stays: the `most` rows of each group with the greatest at, then key; the others go, oldest first.

    A group's border is found by keeping its `most` greatest rows only, so no task sorts a whole group.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(at), F.desc(key))
    top = df.select(*by, at, key).withColumn("__place", F.row_number().over(order)).filter(F.col("__place") <= most).drop("__place")
    return df.join(top.withColumn("__stays", F.lit(True)), [*by, at, key], "left").withColumn("stays", F.coalesce("__stays", F.lit(False))).drop("__stays")


def expire(df: DataFrame, key: str, at: str, tie: str, state: str, terminal: Sequence[str], ttl: float) -> DataFrame:
    """key, state, age and status of each key: its last state, or 'expired' where that is terminal and older than ttl."""
    last = df.groupBy(key).agg(F.max(at).alias("last"), F.max_by(state, F.struct(at, tie)).alias("state"))
    now = df.agg(F.max(at).alias("now"))
    age = F.col("now") - F.col("last")
    over = F.col("state").isin(*terminal) & (age > ttl)
    return last.crossJoin(F.broadcast(now)).select(key, "state", age.alias("age"), F.when(over, "expired").otherwise(F.col("state")).alias("status"))  # one row


def barrier(df: DataFrame, by: Sequence[str], at: str, member: str, needed: int, deadline: float) -> DataFrame:
    """by, the members seen within the deadline from the group's first row, and whether they are enough."""
    first = df.groupBy(*by).agg(F.min(at).alias("__first"))
    in_time = F.when(F.col(at) <= F.col("__first") + deadline, F.col(member))
    said = matched(df, first, list(by)).groupBy(*by).agg(F.count_distinct(in_time).alias("members"))
    return said.withColumn("complete", F.col("members") >= needed)


def pointers(df: DataFrame, run: str, epoch: str, score: str) -> DataFrame:
    """run, checkpoints, latest, best (least score, then earliest) and how many checkpoints neither points to.

    A checkpoint without a score (null or NaN) is never the best; a run without any score has no best one.
    """
    best = F.min_by(epoch, F.when(told(df, score), F.struct(score, epoch)))
    said = df.groupBy(run).agg(F.count(F.lit(1)).alias("checkpoints"), F.max(epoch).alias("latest"), best.alias("best"))
    held = F.when(F.coalesce(F.col("latest") == F.col("best"), F.lit(True)), 1).otherwise(2)
    return said.withColumn("prunable", F.col("checkpoints") - held)
