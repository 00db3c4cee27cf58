"""What a task or the driver holds must not grow with the tables: read from plans and parts, on small tables."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import checks, evidence, grid, joins
from millrace.operators.cut import parts_for
from millrace.plans.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def most_in_a_part(df):
    return max(r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())


def test_cells_of_a_small_table_are_dealt_over_tasks(spark):
    cells = grid.lattice(spark.range(2000).select(F.col("id").alias("case_id")), 20, 50)
    assert cells.count() == 2_000_000 and most_in_a_part(cells) < 2 * grid.TASK_CELLS


def test_control_flux_sends_no_cells_to_all_tasks(spark, sf_dir):
    assert "Broadcast" not in plan(QUERIES["control_flux"](spark, sf_dir))


def test_obstacle_box_sends_no_cells_to_all_tasks(spark, sf_dir):
    assert "Broadcast" not in plan(QUERIES["obstacle_box"](spark, sf_dir))


def test_snapshot_stability_sends_no_cases_to_all_tasks(spark, sf_dir):
    assert "Broadcast" not in plan(QUERIES["snapshot_stability"](spark, sf_dir))


def test_connected_cases_sends_no_cells_to_all_tasks(spark):
    open_ = {"a": ["..#", "#.#", "#.."], "b": ["..#", "##.", "..."]}
    rows = [(c, y, x, v == "#") for c, lines in open_.items() for y, line in enumerate(lines) for x, v in enumerate(line)]
    found = grid.connected_cases(spark.createDataFrame(rows + [("a", 1, 1, False)], "case_id string, y int, x int, solid boolean"))
    assert "Broadcast" not in plan(found)
    assert {r["case_id"]: r["connected"] for r in found.collect()} == {"a": True, "b": True}
    closed = spark.createDataFrame([(c, y, x, s or c == "b" and (y, x) == (2, 1)) for c, y, x, s in rows], "case_id string, y int, x int, solid boolean")
    assert {r["case_id"]: r["connected"] for r in grid.connected_cases(closed).collect()} == {"a": True, "b": False}


def exchanges(df):
    return [line for line in plan(df).splitlines() if "Exchange" in line]


def test_area_average_shuffles_cases_only(spark, sf_dir):
    assert all("REPARTITION_BY_NUM" in line for line in exchanges(QUERIES["area_average"](spark, sf_dir)))


def test_a_task_of_area_average_holds_few_cases(spark, tmp_path):
    spark.range(2000).withColumnRenamed("id", "s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    said = QUERIES["area_average"](spark, str(tmp_path))
    assert said.count() == 2000 * 240 and most_in_a_part(said) < 2 * 240 * grid.TASK_CELLS // (32 * 48)


def test_time_average_shuffles_cases_only(spark, sf_dir):
    assert all("REPARTITION_BY_NUM" in line for line in exchanges(QUERIES["time_average"](spark, sf_dir)))


def test_case_metrics_sorts_cells_once_an_axis(spark, sf_dir):
    said = plan(QUERIES["case_metrics"](spark, sf_dir))
    assert said.count("- Window [") == 2 and "Broadcast" not in said


@pytest.mark.parametrize("distances", [1, 7, 500_000])
def test_nearest_holds_few_distances_and_numbers_at_once(spark, monkeypatch, distances):
    monkeypatch.setattr(joins, "DISTANCES", distances)
    monkeypatch.setattr(joins, "BLOCK_NUMBERS", 12)
    made = []
    monkeypatch.setattr(joins, "parts_for", lambda rows, each: made.append((rows, each)) or parts_for(rows, each))
    known = spark.createDataFrame([(i, float(i * i), 0.0, 1.0) for i in range(10)], "k bigint, f double, g double, h double")
    said = {r["k"]: r["nearest"] for r in joins.nearest(known, known, "k", ["f", "g", "h"], exclude_self=True).collect()}
    assert said == {0: 1} | {i: i - 1 for i in range(1, 10)} and made == [(10, 4), (10, 4)]


def test_parts_of_missing_parents_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(checks, "parts_for", lambda rows: parts_for(rows, 10))
    child = spark.createDataFrame([(i % 50,) for i in range(90)] + [(None,)], "k bigint")
    found = checks.missing_parents(child, "k", spark.range(40), "id")
    assert found.rdd.getNumPartitions() == 14 and sorted(r["key"] or 0 for r in found.collect()) == [0, *range(40, 50)]


def test_designs_are_dealt_over_tasks(spark, sf_dir, tmp_path):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").drop("p_partkey").limit(1).crossJoin(spark.range(50_000).withColumnRenamed("id", "p_partkey"))
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert QUERIES["design_identity"](spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_parts_of_identities_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(evidence, "parts_for", lambda rows: parts_for(rows, 10))
    rows = spark.createDataFrame([(i % 50,) for i in range(90)] + [(None,)], "k bigint")
    found = evidence.identities(rows, [("none", "k", spark.range(40))])
    assert found.rdd.getNumPartitions() == 14 and sorted(r["status"] for r in found.collect()) == ["known"] * 80 + ["none"] * 11
