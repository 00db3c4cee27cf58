"""Rows that are cells of a grid: generated shapes, stencils, case metrics, surface integrals, connectivity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.scalar import floored_ratio
from millrace.operators.cut import checkpointed, dealt

#: Cells that one task of a lattice makes, about.
TASK_CELLS = 250_000


def cells(spark: SparkSession, height: int, width: int, case_id: str = "case") -> DataFrame:
    """case_id, y, x of every cell."""
    n = spark.range(height * width)
    return n.select(F.lit(case_id).alias("case_id"), F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))


def ellipse_distance(grid: DataFrame, cy, cx, a, b, degrees) -> DataFrame:
    """grid with sdf: the algebraic distance (q - 1) * min(a, b) of a lattice point to a turned ellipse with half-axes a, b.

    q is the point's radius in units of the ellipse: the distance is below zero inside. The shape is told by
    numbers or by columns of grid, so each case may have its own.
    """
    shape = {n: F.col(v) if isinstance(v, str) else F.lit(float(v)) for n, v in (("cy", cy), ("cx", cx), ("a", a), ("b", b), ("d", degrees))}
    turn = F.radians(shape["d"])
    dx, dy = F.col("x") - shape["cx"], F.col("y") - shape["cy"]
    u, v = dx * F.cos(turn) + dy * F.sin(turn), dy * F.cos(turn) - dx * F.sin(turn)
    q = F.sqrt((u / shape["a"]) ** 2 + (v / shape["b"]) ** 2)
    return grid.withColumn("sdf", (q - 1) * F.least(shape["a"], shape["b"]))


def lattice(cases: DataFrame, height: int, width: int, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """cases with y, x of every cell of a grid.

    A small table makes many cells, so cases are counted and dealt by keys into tasks of about TASK_CELLS cells.
    What groups or orders cells within a case then needs no shuffle.
    """
    cell = dealt(cases, keys, TASK_CELLS // (height * width)).withColumn("__cell", F.explode(F.sequence(F.lit(0), F.lit(height * width - 1))))
    return cell.withColumn("y", F.floor(F.col("__cell") / width).cast("int")).withColumn("x", (F.col("__cell") % width).cast("int")).drop("__cell")


def bounding_box(grid: DataFrame, margin: float) -> DataFrame:
    """case_id, the box of cells with sdf < margin, one cell larger on each side, and the least sdf on the box's sides.

    The planner takes exploded cells for as few as their cases and would send them to all tasks, so joins name their kind.
    """
    inside = grid.filter(F.col("sdf") < margin)
    box = inside.groupBy("case_id").agg(
        (F.min("y") - 1).alias("y0"), (F.max("y") + 1).alias("y1"), (F.min("x") - 1).alias("x0"), (F.max("x") + 1).alias("x1")
    )
    on_side = F.col("y").isin(F.col("y0"), F.col("y1")) | F.col("x").isin(F.col("x0"), F.col("x1"))
    around = grid.join(box.hint("shuffle_hash"), "case_id").filter("y between y0 and y1 and x between x0 and x1").filter(on_side)
    least = around.groupBy("case_id").agg(F.min("sdf").alias("least_on_side"))
    return box.join(least.hint("shuffle_hash"), "case_id", "left")


def _along(axis: str, keys: Sequence[str]):
    across = "x" if axis == "y" else "y"
    return Window.partitionBy(*keys, across).orderBy(axis)


def central_difference(grid: DataFrame, value: str, axis: str, spacing: float, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """grid with d_<value>_d<axis>; null where a neighbour is missing."""
    w = _along(axis, keys)
    both = (F.lead(axis).over(w) == F.col(axis) + 1) & (F.lag(axis).over(w) == F.col(axis) - 1)
    return grid.withColumn(f"d_{value}_d{axis}", F.when(both, (F.lead(value).over(w) - F.lag(value).over(w)) / (2 * spacing)))


def gradient(grid: DataFrame, value: str, axis: str, spacing: float, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """grid with g_<value>_d<axis>: second order everywhere, one-sided at the ends."""
    w = _along(axis, keys)
    f0, f1, f2, b1, b2 = F.col(value), F.lead(value, 1).over(w), F.lead(value, 2).over(w), F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    inner, start, end = (f1 - b1) / (2 * spacing), (-3 * f0 + 4 * f1 - f2) / (2 * spacing), (3 * f0 - 4 * b1 + b2) / (2 * spacing)
    return grid.withColumn(f"g_{value}_d{axis}", F.coalesce(inner, start, end))


def vorticity(grid: DataFrame, u: str = "u", v: str = "v", spacing: float = 1.0, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    out = gradient(gradient(grid, v, "x", spacing, keys), u, "y", spacing, keys)
    return out.withColumn("vorticity", F.col(f"g_{v}_dx") - F.col(f"g_{u}_dy")).drop(f"g_{v}_dx", f"g_{u}_dy")


def _stencils(grid: DataFrame, fields: Sequence[tuple[str, str]], spacing: float, keys: Sequence[str]) -> DataFrame:
    """grid with __whole, whether the cell and its four neighbours are fluid, and __size<i>, |du/dx + dv/dy| of the i-th u, v.

    All windows of an axis stand together, so that cells are sorted once an axis, whatever the number of fields.
    """
    said, whole, parts = grid, F.col("fluid"), [[] for _ in fields]
    for axis, columns in (("x", [u for u, _ in fields]), ("y", [v for _, v in fields])):
        w = _along(axis, keys)
        both = (F.lead(axis).over(w) == F.col(axis) + 1) & (F.lag(axis).over(w) == F.col(axis) - 1)
        beside = F.coalesce(F.lag("fluid").over(w), F.lit(False)) & F.coalesce(F.lead("fluid").over(w), F.lit(False))
        slopes = {f"__d{axis}{i}": F.when(both, (F.lead(c).over(w) - F.lag(c).over(w)) / (2 * spacing)) for i, c in enumerate(columns)}
        said = said.withColumns({f"__beside_{axis}": beside, **slopes})
        whole = whole & F.col(f"__beside_{axis}")
        for i, terms in enumerate(parts):
            terms.append(F.col(f"__d{axis}{i}"))
    return said.withColumns({"__whole": whole, **{f"__size{i}": F.abs(dx + dy) for i, (dx, dy) in enumerate(parts)}})


def mean_divergence(grid: DataFrame, u: str, v: str, spacing: float, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """keys, stencils, mean |du/dx + dv/dy| over cells whose four neighbours are fluid too."""
    d = _stencils(grid, [(u, v)], spacing, keys).filter("__whole")
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("stencils"), F.avg("__size0").alias("divergence"))


def case_metrics(grid: DataFrame, inlet_velocity: float, spacing: float, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """keys with relative_l2, obstacle_speed, divergence of the prediction and of the solution, in one pass.

    grid: pred_u, pred_v, sol_u, sol_v, fluid, obstacle for each cell.
    """
    off = (F.col("pred_u") - F.col("sol_u")) ** 2 + (F.col("pred_v") - F.col("sol_v")) ** 2
    size = F.col("sol_u") ** 2 + F.col("sol_v") ** 2
    speed = F.sqrt(F.col("pred_u") ** 2 + F.col("pred_v") ** 2)
    cells = _stencils(grid, [("pred_u", "pred_v"), ("sol_u", "sol_v")], spacing, keys)
    return cells.groupBy(*keys).agg(
        floored_ratio(F.sqrt(F.sum(F.when(F.col("fluid"), off))), F.sqrt(F.sum(F.when(F.col("fluid"), size))), 1e-8).alias("relative_l2"),
        (F.avg(F.when(F.col("obstacle"), speed)) / inlet_velocity).alias("obstacle_speed"),
        F.avg(F.when(F.col("__whole"), F.col("__size0"))).alias("pred_divergence"),
        F.avg(F.when(F.col("__whole"), F.col("__size1"))).alias("sol_divergence"),
    )


def surface_flux(grid: DataFrame, box: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """keys, the x-force on the box, and the sums of pressure, rho u u and rho u v over each of its four sides. grid: rho, u, v."""
    inside = grid.join(box.hint("shuffle_hash"), list(keys)).filter("y between y0 and y1 and x between x0 and x1")
    values = {"pressure": (F.col("rho") - 1) / 3, "uu": F.col("rho") * F.col("u") * F.col("u"), "uv": F.col("rho") * F.col("u") * F.col("v")}
    sides = {"left": F.col("x") == F.col("x0"), "right": F.col("x") == F.col("x1"), "bottom": F.col("y") == F.col("y0"), "top": F.col("y") == F.col("y1")}
    sums = inside.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(at, value)), F.lit(0.0)).alias(f"{side}_{name}") for side, at in sides.items() for name, value in values.items()])
    force = F.expr("left_pressure + left_uu - right_pressure - right_uu + bottom_uv - top_uv")
    return sums.select(*keys, force.alias("force_x"), *[f"{side}_{name}" for side in sides for name in values])


def masked_loss(grid: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("case_id",), floor: float = 1e-6, reference_speed: float = 1.0) -> DataFrame:
    """keys and, for each channel c with pred_c and sol_c, the squared error over fluid cells relative to the channel's energy.

    Both are means over all cells, those that are not fluid counting zero. loss_obstacle is the mean of the
    predicted speed's square inside the obstacle, in units of the reference speed.
    """
    over_fluid = lambda value: F.avg(F.when(F.col("fluid"), value).otherwise(0.0))
    error = lambda c: over_fluid((F.col(f"pred_{c}") - F.col(f"sol_{c}")) ** 2)
    inside = F.avg(F.when(~F.col("fluid"), F.col("pred_u") ** 2 + F.col("pred_v") ** 2).otherwise(0.0)) / reference_speed**2
    terms = [floored_ratio(error(c), over_fluid(F.col(f"sol_{c}") ** 2), floor).alias(f"loss_{c}") for c in channels]
    return grid.groupBy(*keys).agg(*terms, inside.alias("loss_obstacle"))


def snapshot_stability(grid: DataFrame, keys: Sequence[str] = ("case_id", "step"), *, low: float = 0.5, high: float = 1.5, fastest: float = 0.2) -> DataFrame:
    """keys with least and greatest density, greatest speed, mass, and stable. grid: rho, u, v."""
    bad = F.isnan("rho") | F.isnan("u") | F.isnan("v") | F.col("rho").isNull() | F.col("u").isNull() | F.col("v").isNull()
    said = grid.groupBy(*keys).agg(
        F.min("rho").alias("least_rho"), F.max("rho").alias("greatest_rho"), F.max(F.hypot("u", "v")).alias("fastest"), F.sum("rho").alias("mass"), F.bool_or(bad).alias("__bad")
    )
    good = ~F.col("__bad") & (F.col("least_rho") >= low) & (F.col("greatest_rho") <= high) & (F.col("fastest") <= fastest)
    return said.withColumn("stable", good).drop("__bad")


def time_average(grid: DataFrame, values: Sequence[str], keys: Sequence[str] = ("case_id", "y", "x")) -> DataFrame:
    return grid.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def thinned(grid: DataFrame, every_y: int, every_x: int) -> DataFrame:
    return grid.filter((F.col("y") % every_y == 0) & (F.col("x") % every_x == 0))


def connected_cases(grid: DataFrame, keys: Sequence[str] = ("case_id",), *, most_rounds: int = 10_000) -> DataFrame:
    """keys, connected: whether open cells lead from the first column to the last, over sides.

    Cells in a row's run of open cells are one node, told by windows, as are the runs that touch in neighbouring
    rows: these are edges. Labels then go to the least over edges and from there to the label's own label, so rounds
    grow with the logarithm of the longest detour. Each round is a checkpoint. Joins are by sorted shuffles: the
    planner's sizes are those of the table that the cells come from, and it would send whole tables through the driver.
    """
    keys = list(keys)
    line, column = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    begins = F.coalesce(F.col("x") - F.lag("x").over(line), F.lit(2)) > 1
    run = F.shiftleft(F.col("y").cast("long"), 32) + F.sum(begins.cast("int")).over(line)
    open_cells = grid.filter("not solid").withColumn("run", run).select(*keys, "y", "x", "run")
    above = F.when(F.lag("y").over(column) == F.col("y") - 1, F.lag("run").over(column))
    touching = open_cells.select(*keys, above.alias("a"), F.col("run").alias("b")).filter("a is not null").distinct()
    edges = checkpointed(touching.unionByName(touching.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))))
    ends = grid.groupBy(*keys).agg(F.min("x").alias("__first"), F.max("x").alias("__last"))
    runs = checkpointed(open_cells.groupBy(*keys, "run").agg(F.min("x").alias("__from"), F.max("x").alias("__to")))
    labels = runs.select(*keys, "run", F.col("run").alias("label"))
    for _ in range(most_rounds):
        seen = edges.join(labels.withColumnRenamed("run", "b").hint("merge"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("run")).agg(F.min("label").alias("seen"))
        near = labels.join(seen.hint("merge"), [*keys, "run"], "left").select(*keys, "run", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        # All that share a label take the least that any of them sees, and from there that label's own.
        hook = near.groupBy(*keys, "old").agg(F.min("label").alias("hook"))
        hooked = checkpointed(near.join(hook.hint("merge"), [*keys, "old"]).select(*keys, "run", "old", F.col("hook").alias("label")))
        jump = hooked.select(*keys, F.col("run").alias("label"), F.col("label").alias("own"))
        new = checkpointed(hooked.join(jump.hint("merge"), [*keys, "label"], "left").select(*keys, "run", "old", F.least("label", "own").alias("label")))
        labels = new.select(*keys, "run", "label")
        if new.filter("label <> old").isEmpty():
            break
    at = runs.join(labels.hint("merge"), [*keys, "run"]).join(ends.hint("merge"), keys)
    sides = at.groupBy(*keys, "label").agg(F.bool_or(F.col("__from") == F.col("__first")).alias("__in"), F.bool_or(F.col("__to") == F.col("__last")).alias("__out"))
    whole = sides.groupBy(*keys).agg(F.bool_or(F.col("__in") & F.col("__out")).alias("connected"))
    return ends.select(*keys).join(whole.hint("merge"), keys, "left").select(*keys, F.coalesce("connected", F.lit(False)).alias("connected"))
