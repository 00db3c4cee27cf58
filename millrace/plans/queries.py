"""Queries on the driver tables, one or more for each family of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import scalar
from millrace.operators import checks, evaluation, grid, joins, lineage, profile, sampling, series
from millrace.operators.cut import checkpointed
from millrace.operators.quantiles import quantiles
from millrace.plans.tables import event_rows, order_metrics, table
from millrace.streaming import folds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# -- gates and summaries

GATES = [
    ("median gap", "gap_pct.median", "le", 60.0),
    ("p90 gap", "gap_pct.p90", "le", 500.0),
    ("p95 gap", "gap_pct.p95", "lt", 1000.0),
    ("greatest gap", "gap_pct.maximum", "lt", 100.0),
    ("lines a part", "lines.per_part", "ge", 1.0),
    ("unmeasured", "nothing.at_all", "gt", 0.0),
]


def _gates_on(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    metrics = checkpointed(orders).withColumn("all", F.lit("gap_pct"))
    said = profile.summarise_closed(metrics, ["all"], F.col("gap_pct"), F.col("valid"))
    cells = profile.long_form(said, ["median", "p90", "p95", "maximum"], ["all", "status"])
    evidence = cells.select(F.concat_ws(".", "all", "column").alias("metric"), "value", "status")
    lines = table(spark, sf_dir, "lineitem").agg((F.count(F.lit(1)) / F.count_distinct("l_partkey")).alias("value"))
    evidence = evidence.unionByName(lines.select(F.lit("lines.per_part").alias("metric"), "value", F.lit("valid").alias("status")))
    gates = spark.createDataFrame(GATES, "name string, metric string, operator string, threshold double")
    return rounded(evaluation.evaluate_gates(gates, evidence), 4, "value")


@query
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates on the complete orders only."""
    return _gates_on(spark, sf_dir, order_metrics(spark, sf_dir).filter("valid"))


@query
def gate_report_all_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates on all orders: one invalid order makes those on the gap red."""
    return _gates_on(spark, sf_dir, order_metrics(spark, sf_dir))


@query
def gate_verdict_all_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.verdict(gate_report_all_orders(spark, sf_dir))


@query
def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.verdict(gate_report(spark, sf_dir))


@query
def metric_summary_fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = profile.summarise_closed(checkpointed(order_metrics(spark, sf_dir)), ["o_orderpriority"], F.col("gap_pct"), F.col("valid"))
    return rounded(said, 4, "median", "p90", "p95", "maximum")


@query
def metric_summary_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = profile.summarise_closed(checkpointed(order_metrics(spark, sf_dir).filter("valid")), ["o_orderpriority"], F.col("gap_pct"), F.col("valid"))
    return rounded(said, 4, "median", "p90", "p95", "maximum")


@query
def worst_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = profile.worst(order_metrics(spark, sf_dir).filter("valid"), [], "gap_pct", "o_orderkey", 20)
    return rounded(top.select("o_orderkey", "o_orderpriority", "gap_pct", F.col("place").cast("long").alias("place")), 4, "gap_pct")


@query
def bootstrap_median_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = profile.bootstrap_median(table(spark, sf_dir, "supplier"), ["s_nationkey"], F.col("s_acctbal"), F.col("s_suppkey"), resamples=200)
    return rounded(said, 6, "low", "high")


@query
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = profile.column_profile(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(said, 4, "minimum", "maximum", "mean", "std", "q05", "q50", "q95")


@query
def distribution_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = profile.distribution(table(spark, sf_dir, "orders"), ["o_orderpriority"], F.col("o_totalprice"))
    return rounded(said, 2, "minimum", "maximum", "mean", "q05", "q25", "q50", "q75", "q95")


@query
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 6, "r")


@query
def representative_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.representative_and_extreme(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", "c_custkey"), 4, "median")


@query
def group_argmin_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tie"))
    return profile.best_of(rows, ["l_suppkey"], "l_extendedprice", "tie")


@query
def value_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted series of a distribution: each distinct value and the share of rows up to it, by group."""
    rows = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("p_brand")
    share = F.sum("n").over(w.orderBy("p_size").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w)
    return rows.select("p_brand", F.col("p_size").cast("long").alias("p_size"), "n", F.round(share, 6).alias("share"))


# -- checks and joins


@query
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    rules = {
        "quantity": F.col("l_quantity").between(1, 50),
        "discount": (F.col("l_discount") >= 0) & (F.col("l_discount") <= 0.1),
        "cheap": F.col("l_extendedprice") < 50_000,
        "returned_open": ~((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")),
    }
    return checks.violations(rows, rules)


@query
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def complete_join_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    return joins.join_audit(orders, lines, "key").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_right").alias("lines"))


@query
def missing_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    parts = [
        ("orders.customer", checks.missing_parents(orders, "o_custkey", table(spark, sf_dir, "customer"), "c_custkey")),
        ("lineitem.orders", checks.missing_parents(lines, "l_orderkey", orders, "o_orderkey")),
        ("lineitem.part", checks.missing_parents(lines, "l_partkey", table(spark, sf_dir, "part"), "p_partkey")),
        ("lineitem.supplier", checks.missing_parents(lines, "l_suppkey", table(spark, sf_dir, "supplier"), "s_suppkey")),
        ("customer.orders", checks.missing_parents(table(spark, sf_dir, "customer"), "c_custkey", orders, "o_custkey")),
        ("lineitem.open_orders", checks.missing_parents(lines, "l_orderkey", orders.filter("o_orderstatus = 'O'"), "o_orderkey")),
    ]
    out = None
    for name, keys in parts:
        one = keys.select(F.lit(name).alias("link"), "key")
        out = one if out is None else out.unionByName(one)
    return out


@query
def artifact_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("sha", F.sha2(F.concat_ws("|", "c_custkey", "c_name", "c_mktsegment"), 256))
    found = rows.filter("c_acctbal > 0").withColumn("sha", F.when(F.col("c_mktsegment") == "BUILDING", F.lit("old")).otherwise(F.col("sha")))
    return checks.artifact_difference(rows.filter("c_acctbal < 9000"), found, "c_custkey", "sha")


@query
def nearest_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    unit = parts.select("p_partkey", ((F.col("p_size") - 1) / 49.0).alias("size"), ((F.col("p_retailprice") - 900) / 1200.0).alias("price"))
    found = joins.nearest(unit.filter("p_partkey % 20 = 0"), unit.filter("p_partkey % 20 <> 0"), "p_partkey", ["size", "price"])
    return rounded(found, 8, "distance2")


@query
def nearest_design_all_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of nearest_design against all parts but the query itself."""
    parts = table(spark, sf_dir, "part")
    unit = parts.select("p_partkey", ((F.col("p_size") - 1) / 49.0).alias("size"), ((F.col("p_retailprice") - 900) / 1200.0).alias("price"))
    found = joins.nearest(unit.filter("p_partkey % 20 = 0"), unit, "p_partkey", ["size", "price"], exclude_self=True)
    return rounded(found, 8, "distance2")


@query
def shared_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with open and with finished orders, by set operations."""
    orders = table(spark, sf_dir, "orders")
    a = orders.filter("o_orderstatus = 'O'").select("o_custkey")
    b = orders.filter("o_orderstatus = 'F'").select("o_custkey")
    parts = {"both": a.intersect(b), "first_only": a.subtract(b), "either": a.union(b).distinct()}
    out = None
    for name, part in parts.items():
        one = part.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("sum_key"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def probe_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    levels = spark.createDataFrame([(20,), (40,), (300,), (400,)], "reynolds bigint")
    members = spark.createDataFrame([("m17",), ("m23",), ("m31",)], "member string")
    regime = F.when(F.col("reynolds").isin(20, 400), "ood").otherwise("boundary")
    return sampling.probe_grid(nations, levels, members).withColumn("regime", regime)


# -- sampling


@query
def hash_rank_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    return sampling.hash_split(rows, "split-v1", "c_custkey", {"train": 0.6, "validation": 0.2, "test": 0.2})


@query
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_rank_split(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first"))


@query
def hash_topk_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").filter((F.col("p_size") >= 2) & (F.col("p_size") <= 49)).select("p_partkey", "p_name")
    return sampling.hash_top(rows, "probe-v1", "p_partkey", 10)


@query
def epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.epoch_batches(table(spark, sf_dir, "orders").select("o_orderkey"), "orders", 17, 3, "o_orderkey", 64)


@query
def stratified_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    design = sampling.stratified_design(spark, 256, {"aspect_ratio": (0.5, 1.0), "rotation": (0.0, 30.0), "reynolds": (40.0, 300.0)}, "design-v1")
    return rounded(design, 8, "aspect_ratio", "rotation", "reynolds")


# -- baselines and ensembles


@query
def mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = evaluation.mean_vectors(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return means.select(F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("i", "mean")).select("label", F.col("i").cast("long").alias("i"), F.round("mean", 6).alias("mean"))


@query
def zscore_train_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    said = evaluation.moments(lines, ["l_quantity", "l_extendedprice"], F.col("l_returnflag") != "R")
    rows = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_extendedprice").alias("l_extendedprice"))
    z = evaluation.standardised(rows, ["l_quantity", "l_extendedprice"], said)
    back = evaluation.restored(z.select("l_orderkey", "l_linenumber", "z_l_quantity"), ["l_quantity"], said)
    out = z.join(back.select("l_orderkey", "l_linenumber", F.round("l_quantity", 4).alias("quantity_again")), ["l_orderkey", "l_linenumber"])
    return out.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round("z_l_quantity", 5).alias("z_quantity"), F.round("z_l_extendedprice", 5).alias("z_price"), "quantity_again"
    )


@query
def ensemble_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members are suppliers of one part in one flag: their unit prices' variance, in units of the flag's."""
    lines = table(spark, sf_dir, "lineitem").withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity"))
    scale = lines.groupBy("l_returnflag").agg(F.var_pop("unit").alias("scale"))
    rows = lines.join(scale, "l_returnflag")
    return rounded(evaluation.ensemble_variance(rows, ["l_returnflag"], ["l_partkey"], "unit", "scale"), 5, "variance")


@query
def regime_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    said = evaluation.ratio_of_medians(orders, ["o_orderpriority"], F.col("o_totalprice"), F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O")
    return rounded(said, 4, "top", "bottom", "ratio")


@query
def sign_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal", (F.lit(10_000) - F.col("c_custkey") * 7 % 20_000).cast("double").alias("other"))
    said = evaluation.sign_agreement(rows, ["c_nationkey"], "c_acctbal", "other", 1e-5)
    return said.withColumn("c_nationkey", F.col("c_nationkey").cast("long"))


# -- series


@query
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return series.sequence_gaps(lines.distinct(), ["l_orderkey"], "l_linenumber", 1)


@query
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose turns do not follow one another from 0, and how often each move from role to role that is not `user` to `assistant` occurs."""
    rows = table(spark, sf_dir, "conversations")
    legal = spark.createDataFrame([("user", "assistant")], "previous string, state string")
    moves = series.illegal_transitions(rows, ["conv_id"], ["turn"], "role", legal)
    gaps = series.sequence_gaps(rows.select("conv_id", "turn").distinct(), ["conv_id"], "turn")
    moved = moves.select("conv_id", F.concat_ws(" to ", "previous", "state").alias("what"), "n")
    return moved.unionByName(gaps.groupBy("conv_id").agg(F.lit("turns").alias("what"), F.count(F.lit(1)).alias("n")).select("conv_id", "what", "n"))


@query
def regular_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.regularity(event_rows(spark, sf_dir), ["user_id"], "seconds")


@query
def trailing_range_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).select("user_id", "event_id", "seconds", "value")
    said = series.trailing_mean(rows, ["user_id"], "seconds", "value", 86_400)
    return rounded(said.select("event_id", "n_trailing", "trailing_mean"), 5, "trailing_mean")


@query
def last_day_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.last_range_mean(event_rows(spark, sf_dir), ["event_type"], "seconds", "value", 86_400), 5, "mean")


@query
def spectral_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of each kind of event: its strongest period between four hours and two days."""
    rows = event_rows(spark, sf_dir)
    hourly = rows.groupBy("event_type", F.floor(F.col("seconds") / 3600).alias("hour")).agg(F.count(F.lit(1)).alias("n_events"))
    bounds = rows.agg(F.floor(F.min("seconds") / 3600).alias("a"), F.floor(F.max("seconds") / 3600).alias("b"))
    kinds = rows.select("event_type").distinct().crossJoin(F.broadcast(bounds))  # one row
    whole = kinds.select("event_type", F.explode(F.sequence("a", "b")).alias("hour")).join(hourly, ["event_type", "hour"], "left").fillna(0, ["n_events"])
    said = series.spectral_peak(whole, ["event_type"], "hour", "n_events", 1 / 48, 1 / 4)
    return rounded(said, 5, "frequency", "power")


@query
def debounce_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).select("user_id", "event_id", "seconds")
    return series.debounced(rows, ["user_id"], "seconds", ["event_id"], 3600)


@query
def replay_after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events after a cursor that is at most their own last event."""
    rows = event_rows(spark, sf_dir).select("user_id", "event_id")
    last = rows.groupBy("user_id").agg(F.max("event_id").alias("last"))
    seen = rows.join(last, "user_id").withColumn("cursor", F.least(F.lit(5000), F.col("last")).cast("long"))
    return series.replay(seen, ["user_id"], "event_id", F.col("cursor")).select("user_id", "event_id")


@query
def future_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).select("user_id", "event_id")
    return series.future_cursors(rows, ["user_id"], "event_id", F.when(F.col("user_id") % 10 == 0, F.lit(10**12)).otherwise(F.col("user_id")).cast("long"))


@query
def monotone_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).select("user_id", "event_id", "seconds", (F.col("event_id") * 37 % 1100 / 1000).alias("progress"))
    said = series.monotone_progress(rows, ["user_id"], ["seconds", "event_id"], "progress")
    return said.groupBy("user_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("ignored"))


@query
def grid_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").cast("long").alias("year")).agg(F.avg("o_totalprice").alias("mean"), F.count(F.lit(1)).alias("n"))
    said = series.grid_deltas(rows, "year", ["mean", "n"], ["o_orderpriority"])
    return rounded(said, 2, "mean", "mean_delta")


# -- grids


HEIGHT, WIDTH = 32, 48


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turned ellipse for each supplier, on a grid of its own."""
    k = F.col("s_suppkey")
    cases = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k).alias("case_id"), (9 + k % 4).alias("a"), (5 + k % 3).alias("b"), (k * 7 % 30).alias("degrees"))
    return grid.ellipse_distance(grid.lattice(cases, HEIGHT, WIDTH), 15, 20, "a", "b", "degrees")


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


@query
def ellipse_sdf_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _long(_shapes(spark, sf_dir), "y", "x")
    return g.select("case_id", "y", "x", F.round("sdf", 6).alias("sdf"), (F.col("sdf") <= 0).alias("obstacle"), F.round(scalar.clip(F.col("sdf") / 18, -1.0, 1.0), 6).alias("channel"))


@query
def obstacle_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_long(grid.bounding_box(_shapes(spark, sf_dir), 8.0), "y0", "y1", "x0", "x1"), 6, "least_on_side")


def _field(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.lit(0.1) + F.col("x") * F.col("y") / 65536
    v = (F.col("x") - F.col("y")) / 2048
    fluid = F.col("sdf") > 0
    return _shapes(spark, sf_dir).select("case_id", "y", "x", fluid.alias("fluid"), (~fluid).alias("obstacle"), u.alias("sol_u"), v.alias("sol_v"), (u * 1.25).alias("pred_u"), (v - 0.0625).alias("pred_v"))


def _drags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each case the drag that the solver, the head and the field say."""
    k, cost = F.col("s_suppkey"), F.col("s_acctbal")
    rows = table(spark, sf_dir, "supplier")
    return rows.select(F.concat(F.lit("s"), k).alias("case_id"), (1 + cost / 20_000).alias("cd_solver"), (1 + cost / 20_000 + (k % 7) / 100).alias("cd_head"), (1 + cost / 20_000 - (k % 11) / 50).alias("cd_field"))


@query
def case_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven metrics of a case: four on its fields, three on its drag."""
    said = grid.case_metrics(_field(spark, sf_dir), 0.1, 2.0).join(evaluation.drag_errors(_drags(spark, sf_dir)).hint("shuffle_hash"), "case_id")
    return rounded(said, 6, "relative_l2", "obstacle_speed", "pred_divergence", "sol_divergence", "head_error", "field_error", "gap")


@query
def disagreement_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose head and field disagree by more than a tenth of the solver's drag, with the status of the gap and the axis that all share."""
    said = evaluation.disagreement(_drags(spark, sf_dir), 10.0)
    return rounded(said.select("case_id", "gap", "disagrees", "status", "axis_low", "axis_high"), 6, "gap", "axis_low", "axis_high")


@query
def masked_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of a case's loss and their weighted sum."""
    terms = grid.masked_loss(_field(spark, sf_dir), ["u", "v"], reference_speed=0.1)
    drag = _drags(spark, sf_dir).select("case_id", (scalar.floored_ratio(F.col("cd_head") - F.col("cd_solver"), F.abs("cd_solver"), 0.1) ** 2).alias("loss_cd"))
    total = F.col("loss_u") + F.col("loss_v") + 0.25 * F.col("loss_obstacle") + 0.5 * F.col("loss_cd")
    return rounded(terms.join(drag.hint("shuffle_hash"), "case_id").withColumn("total", total), 6, "loss_u", "loss_v", "loss_obstacle", "loss_cd", "total")


@query
def vorticity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _field(spark, sf_dir).select("case_id", "y", "x", F.col("sol_u").alias("u"), (F.col("sol_v") * F.col("sol_v")).alias("v"))
    return rounded(_long(grid.thinned(grid.vorticity(g), 4, 2), "y", "x").select("case_id", "y", "x", "vorticity"), 9, "vorticity")


@query
def control_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _field(spark, sf_dir).select("case_id", "y", "x", F.col("sol_u").alias("u"), F.col("sol_v").alias("v"), (F.lit(1.0) + F.col("x") / 4096 - F.col("y") / 8192).alias("rho"))
    said = grid.surface_flux(g, grid.bounding_box(_shapes(spark, sf_dir), 8.0))
    return rounded(said.select("case_id", "force_x", "left_pressure", "right_uu", "top_uv"), 7, "force_x", "left_pressure", "right_uu", "top_uv")


def _steps(g: DataFrame, n: int) -> DataFrame:
    return g.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


@query
def snapshot_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step's extremes, whether they are within bounds, and the drift of the mass from the first step."""
    g = _steps(_field(spark, sf_dir), 3)
    g = g.select("case_id", "step", F.col("sol_u").alias("u"), F.col("sol_v").alias("v"), (F.lit(1.0) + F.col("x") * F.col("step") / 128).alias("rho"))
    said = series.drift(grid.snapshot_stability(g), ["case_id"], "step", "mass")
    return rounded(said, 6, "least_rho", "greatest_rho", "fastest", "mass", "drift")


@query
def time_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's mean over the steps, with the least and greatest of the whole history."""
    g = _steps(_field(spark, sf_dir), 4).select("case_id", "y", "x", (F.col("sol_u") * (1 + F.col("step"))).alias("u"))
    ends = g.groupBy("case_id").agg(F.min("u").alias("least"), F.max("u").alias("greatest"))
    return rounded(_long(grid.time_average(g, ["u"]).join(ends.hint("shuffle_hash"), "case_id"), "y", "x"), 8, "u", "least", "greatest")


@query
def area_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("case_id"))
    g = grid.lattice(cases, HEIGHT, WIDTH).withColumn("value", (F.col("y") + 2 * F.col("x")).cast("double"))
    along_x = joins.overlap_average(g, "x", WIDTH, 20, "value", ["case_id", "y"])
    both = joins.overlap_average(along_x, "y", HEIGHT, 12, "value", ["case_id", "x"])
    return rounded(_long(both, "y", "x"), 6, "value")


@query
def grid_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A winding way through walls, and a closed wall: by the supplier's number."""
    k = F.col("k")
    cases = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("case_id"), (F.col("s_suppkey") % 5).alias("k"))
    g = grid.lattice(cases, 12, 16)
    winding = (F.col("x") % 4 == 2) & (F.col("y") != F.when(F.col("x") % 8 == 2, 1).otherwise(10))
    closed = (F.col("x") == 6 + k) | (F.col("x") == F.col("y"))
    return grid.connected_cases(g.withColumn("solid", F.when(k < 3, winding).otherwise(closed)).drop("k"))


# -- lineage, identity, text


@query
def lineage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    name = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    orders = table(spark, sf_dir, "orders")
    edges = (
        nation.select(name("nation", "n_nationkey").alias("child"), name("region", "n_regionkey").alias("parent"))
        .unionByName(customer.select(name("customer", "c_custkey").alias("child"), name("nation", "c_nationkey").alias("parent")))
        .unionByName(orders.select(name("order", "o_orderkey").alias("child"), name("customer", "o_custkey").alias("parent")))
    )
    nodes = edges.select(F.col("child").alias("sha")).unionByName(edges.select(F.col("parent").alias("sha")))
    said = lineage.levels(nodes, edges)
    return said.groupBy(F.col("level").cast("long").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("sha").alias("first"), F.max("sha").alias("last"))


@query
def lineage_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    nodes = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("sha"), F.lit("nation").alias("kind")).unionByName(
        customer.select(F.concat(F.lit("c"), "c_custkey").alias("sha"), F.lit("customer").alias("kind"))
    )
    parent = F.when(F.col("c_acctbal") > 9500, F.lit("n999")).otherwise(F.concat(F.lit("n"), "c_nationkey"))
    edges = customer.filter("c_acctbal > -900").select(F.concat(F.lit("c"), "c_custkey").alias("child"), parent.alias("parent"), F.when(F.col("c_acctbal").between(0, 200), "region").otherwise("nation").alias("parent_kind"))
    rules = spark.createDataFrame([("nation", [], []), ("customer", ["nation"], ["nation"])], "kind string, required array<string>, allowed array<string>")
    return lineage.lineage_problems(nodes, edges, rules)


@query
def content_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    text = scalar.canonical_json("n_nationkey", "n_name", "n_regionkey")
    return rows.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), text.alias("canonical"), F.sha2(text, 256).alias("sha256"), scalar.content_id(text).alias("id"), scalar.seed_of(text).alias("seed"))


@query
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("before"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("before"))
    rows = docs.unionByName(pages).withColumn("after", scalar.redact(F.col("before")))
    return rows.filter("before <> after").select("id", F.sha2("after", 256).alias("sha256"), (F.length("before") - F.length("after")).cast("long").alias("shorter"))


@query
def clock_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    return rows.select("event_id", scalar.utc_text(F.col("ts")).alias("at"), scalar.seconds_to_midnight(F.col("ts")).cast("long").alias("to_midnight"))


@query
def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.range(1, 101).withColumnRenamed("id", "epoch")
    rate = scalar.warmup_cosine(F.col("epoch"), 100, 5, 1e-3, 1e-5)
    return n.select("epoch", F.round(rate, 9).alias("rate"), F.round(scalar.half_cosine_ramp(F.col("epoch") * 30, 2000), 9).alias("ramp"), scalar.round_half_up(F.col("epoch") / 8).cast("long").alias("eighths"))


@query
def registry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events against a registry of the kinds and the property keys that each may have."""
    rows = event_rows(spark, sf_dir).select("event_type", F.array_join(F.array_sort(F.json_object_keys("props")), ",").alias("keys"))
    registry = spark.createDataFrame([("view",), ("click",), ("purchase",)], "event_type string").withColumn("known", F.lit(True))
    said = rows.groupBy("event_type", "keys").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(registry), "event_type", "left")
    return said.select("event_type", "keys", "n", F.coalesce("known", F.lit(False)).alias("known"))


# -- keyed state


@query
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.token_bucket(event_rows(spark, sf_dir), "user_id", "seconds", "event_id", 2, 86_400)


@query
def daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's requests in order: the kind may be closed, then at most 20, then at most 3,600 reserved seconds before and with it.

    A day's rows are numbered within hours first, so that no task sorts a whole day.
    """
    rows = event_rows(spark, sf_dir).withColumn("day", F.floor(F.col("seconds") / 86_400)).withColumn("cost", (60 + F.col("event_id") % 7 * 60).cast("long"))
    closed = F.col("event_type") == "error"
    asked = series.running(rows, ["day"], "seconds", 3600, ["seconds", "event_id"], {"place": F.when(~closed, F.lit(1)).otherwise(0), "reserved": F.when(~closed, F.col("cost")).otherwise(0)})
    reason = F.when(closed, "closed").when(F.col("place") > 20, "count").when(F.col("reserved") > 3600, "seconds")
    return asked.select("event_id", "day", reason.isNull().alias("admitted"), reason.alias("reason"))


@query
def idempotency_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).select(F.concat_ws("/", "user_id", "event_type").alias("key"), F.sha2("props", 256).alias("digest"), "event_id")
    first = F.min_by("digest", "event_id")
    said = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("digest").alias("digests"), first.alias("first"), F.min("event_id").alias("job"))
    return said.withColumn("conflict", F.col("digests") > 1)


@query
def lease_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.element_at(F.array(*[F.lit(x) for x in ("claim", "renew", "succeed", "fail", "reap")]), (F.col("event_id") % 5 + 1).cast("int"))
    events = event_rows(spark, sf_dir).select(
        F.col("user_id").alias("case_id"), F.col("event_id").alias("sequence"), "seconds", op.alias("op"), (F.col("event_id") % 2).cast("string").alias("owner"), F.lit("d").alias("digest"), F.lit("ERR").alias("code"),
        F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 3 + 1).alias("attempt"),
    )
    return folds.lease_replay(events, minutes=24 * 60)


@query
def sweep_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By final state: cases, retries, and how often each failure code was met."""
    last = lease_replay(spark, sf_dir).groupBy("case_id").agg(F.max_by(F.struct("state", "attempt", "failure_codes"), "sequence").alias("s")).select("case_id", "s.*")
    states = last.groupBy("state").agg(F.lit("cases").alias("what"), F.count(F.lit(1)).alias("n"))
    retries = last.groupBy("state").agg(F.lit("retries").alias("what"), F.sum(F.greatest(F.lit(0), F.col("attempt") - 1)).cast("long").alias("n"))
    codes = last.select("state", F.explode(F.split("failure_codes", ",")).alias("what")).filter("what <> ''").groupBy("state", "what").agg(F.count(F.lit(1)).alias("n"))
    return states.unionByName(retries).unionByName(codes)


@query
def bounded_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by user that find fewer than two others of theirs from the day before: how many a kind has, and the most that one found.

    All requests count, taken or not, as load that the others see; token_bucket is the rule by which refusals do not.
    """
    rows = event_rows(spark, sf_dir)
    said = series.trailing_mean(rows, ["user_id"], "seconds", "value", 86_400).withColumn("others", F.col("n_trailing") - 1)
    return said.groupBy("event_type").agg(F.count_if(F.col("others") < 2).alias("taken"), F.count_if(F.col("others") >= 2).alias("refused"), F.max("others").alias("most"))


@query
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    reason = evaluation.readiness(rows, [("overdrawn", F.col("s_acctbal") < 0), ("far", F.col("s_nationkey") > 20), ("poor", F.col("s_acctbal") < 2000)])
    return rows.select(reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_extendedprice"), {"q01": 0.01, "q50": 0.5, "q995": 0.995})
    return rounded(said, 4, "q01", "q50", "q995")
