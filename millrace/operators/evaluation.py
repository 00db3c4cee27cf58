"""Baselines, normalisation, ensembles, gates and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalar import compare, percent_error
from millrace.operators.quantiles import quantiles


def mean_vectors(df: DataFrame, by: Sequence[str], vector: str) -> DataFrame:
    """by and the element-wise mean of an array column; summed by place, so one group is never gathered."""
    cells = df.select(*by, F.posexplode(vector).alias("__i", "__x"))
    means = cells.groupBy(*by, "__i").agg(F.avg("__x").alias("__m"))
    pairs = F.array_sort(F.collect_list(F.struct("__i", "__m")))  # as many as a vector is long
    return means.groupBy(*by).agg(F.transform(pairs, lambda p: p["__m"]).alias(vector))


def moments(df: DataFrame, columns: Sequence[str], learn_from: Column, floor: float = 1e-6) -> DataFrame:
    """One row: mean and std (population, not under the floor) of each column over the rows to learn from."""
    rows = df.filter(learn_from)
    return rows.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.greatest(F.stddev_pop(c), F.lit(floor)).alias(f"{c}_std") for c in columns])


def standardised(df: DataFrame, columns: Sequence[str], said: DataFrame) -> DataFrame:
    """df with z_<column> by the moments: one row, sent to all."""
    out = df.crossJoin(F.broadcast(said))
    out = out.withColumns({f"z_{c}": (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns})
    return out.drop(*[f"{c}_{m}" for c in columns for m in ("mean", "std")])


def restored(df: DataFrame, columns: Sequence[str], said: DataFrame) -> DataFrame:
    """df with <column> back from z_<column>."""
    out = df.crossJoin(F.broadcast(said))
    out = out.withColumns({c: F.col(f"z_{c}") * F.col(f"{c}_std") + F.col(f"{c}_mean") for c in columns})
    return out.drop(*[f"{c}_{m}" for c in columns for m in ("mean", "std")])


def ensemble_variance(df: DataFrame, group: Sequence[str], cell: Sequence[str], value: str, scale: str) -> DataFrame:
    """group and the mean over its cells of the members' population variance divided by the cell's scale."""
    per_cell = df.groupBy(*group, *cell).agg(F.var_pop(value).alias("__v"), F.first(scale).alias("__s"))
    return per_cell.groupBy(*group).agg(F.count(F.lit(1)).alias("cells"), F.avg(F.col("__v") / F.col("__s")).alias("variance"))


def ratio_of_medians(df: DataFrame, by: Sequence[str], value: Column, top: Column, bottom: Column) -> DataFrame:
    """by, the medians of two kinds of rows, their ratio, status: invalid where a side is missing or the bottom is zero."""
    by = list(by)
    kinds = F.array(F.when(top, F.lit("top")), F.when(bottom, F.lit("bottom")))
    rows = df.select(*by, value.cast("double").alias("__v"), F.explode(kinds).alias("__kind")).filter("__kind is not null")
    middle = quantiles(rows, [*by, "__kind"], F.col("__v"), {"middle": 0.5})
    both = middle.groupBy(*by).agg(*[F.max(F.when(F.col("__kind") == k, F.col("middle"))).alias(k) for k in ("top", "bottom")])
    ratio = F.try_divide("top", "bottom")
    return both.withColumn("ratio", ratio).withColumn("status", F.when(ratio.isNull(), "invalid").otherwise("valid"))


def drag_errors(df: DataFrame) -> DataFrame:
    """case_id with three errors in percent: of the head and of the field against the solver, and between the two."""
    head, field, solver = F.col("cd_head"), F.col("cd_field"), F.col("cd_solver")
    return df.select("case_id", percent_error(head, solver, solver).alias("head_error"), percent_error(field, solver, solver).alias("field_error"), percent_error(head, field, solver).alias("gap"))


def disagreement(df: DataFrame, most: float) -> DataFrame:
    """df with gap, disagrees (the gap is over a tenth of the solver's value), its status against `most`, and the range of all drags."""
    head, field, solver = F.col("cd_head"), F.col("cd_field"), F.col("cd_solver")
    gap = percent_error(head, field, solver)
    flagged = F.abs(head - field) > 0.1 * F.greatest(F.abs(solver), F.lit(0.1))
    ends = df.agg(F.min(F.least(head, field, solver)).alias("axis_low"), F.max(F.greatest(head, field, solver)).alias("axis_high"))
    status = F.when(F.col("gap") <= most, "green").otherwise("red")
    return df.withColumn("gap", gap).withColumn("disagrees", flagged).withColumn("status", status).crossJoin(F.broadcast(ends))  # one row


def sign_agreement(df: DataFrame, by: Sequence[str], left: str, right: str, tolerance: float) -> DataFrame:
    """by, n, n_agree: pairs of slopes of one sign; slopes within the tolerance of zero agree with each other alone."""
    sign = lambda c: F.when(F.abs(F.col(c)) <= tolerance, 0).otherwise(F.signum(c)).cast("int")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(sign(left) == sign(right)).alias("n_agree"))


def evaluate_gates(gates: DataFrame, evidence: DataFrame) -> DataFrame:
    """gates (name, metric, operator, threshold) with value and status; missing, extra, repeated or invalid evidence is red.

    evidence: metric, value, status.
    """
    said = evidence.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value"), F.first("status").alias("evidence"))
    both = gates.join(said, "metric", "full_outer")
    good = (F.col("n") == 1) & (F.col("evidence") == "valid") & compare(F.col("operator"), F.col("value"), F.col("threshold"))
    status = F.when(F.coalesce(good, F.lit(False)), "green").otherwise("red")
    return both.select(F.coalesce("name", F.concat(F.lit("no gate: "), F.col("metric"))).alias("name"), "metric", "operator", "threshold", "value", status.alias("status"))


def verdict(evaluated: DataFrame) -> DataFrame:
    """One row: gates, green ones, status; without gates it is red."""
    green = F.count_if(F.col("status") == "green")
    return evaluated.agg(F.count(F.lit(1)).alias("gates"), green.alias("green"), F.when((F.count(F.lit(1)) > 0) & (green == F.count(F.lit(1))), "green").otherwise("red").alias("status"))


def central_slope(plus: Column, minus: Column, half_step: float) -> Column:
    """The slope between two values, half a step to either side."""
    return (plus - minus) / (2 * half_step)


def report_lines(evaluated: DataFrame) -> DataFrame:
    """place, line: the gates as lines of a Markdown table, in the order of their names; bars inside cells are escaped."""
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    number = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.4f", F.col(c)))
    text = F.concat(F.lit("| "), F.concat_ws(" | ", cell(F.col("name")), cell(F.col("metric")), cell(F.col("operator")), number("threshold"), number("value"), F.col("status")), F.lit(" |"))
    place = F.row_number().over(Window.orderBy("name"))  # gates are few
    return evaluated.select(place.cast("long").alias("place"), text.alias("line"))


def readiness(df: DataFrame, reasons: Sequence[tuple[str, Column]]) -> Column:
    """The first reason that holds, else 'ready'."""
    said = None
    for name, holds in reasons:
        said = F.when(holds, name) if said is None else said.when(holds, name)
    return said.otherwise("ready")
