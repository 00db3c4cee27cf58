"""The tables that the queries read, and small generated ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalar import percent_error


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order or order key of a line: o_orderkey, o_orderpriority, gap_pct, valid.

    gap_pct: how far the lines' sum lies from the order's price, in percent; invalid unless both are finite numbers.
    """
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(price).alias("revenue"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    both = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "full_outer")
    gap = percent_error(F.col("revenue"), F.col("o_totalprice"), F.col("o_totalprice"))
    return both.select(F.coalesce("o_orderkey", "l_orderkey").alias("o_orderkey"), F.coalesce("o_orderpriority", F.lit("none")).alias("o_orderpriority"), gap.alias("gap_pct")).withColumn(
        "valid", F.col("gap_pct").isNotNull()
    )


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with seconds since 1970, whatever the type of ts."""
    rows = table(spark, sf_dir, "events")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("seconds", F.unix_timestamp("ts"))
