"""Queries whose tables hold nulls where a score, a value or a key may stand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalar
from millrace.operators import evidence, profile, sampling, series
from millrace.plans.queries import rounded
from millrace.plans.sql import _EVENTS
from millrace.plans.tables import event_rows, table
from millrace.sources.strict import strict_objects

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


#: Events of users of whom every seventh has no id, with scores that errors, and all rows of every eleventh, lack.
_GAPS = f"{_EVENTS}, g AS (SELECT CASE WHEN user_id % 7 <> 0 THEN user_id END AS k, event_id, seconds, CASE WHEN event_type <> 'error' AND user_id % 11 <> 0 THEN value END AS score FROM e)"


def _with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = (F.col("event_type") != "error") & (F.col("user_id") % 11 != 0)
    rows = event_rows(spark, sf_dir)
    return rows.select(F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("k"), "event_id", "seconds", F.when(scored, F.col("value")).alias("score"))


@query(f"WITH {_GAPS} SELECT k, arg_min(event_id, (score, event_id)) FILTER (score IS NOT NULL) AS event_id, min(score) AS score FROM g GROUP BY k")
def best_of_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.best_of(_with_gaps(spark, sf_dir).select("k", "event_id", "score"), ["k"], "score", "event_id")


@query(f"""
    WITH {_GAPS}, m AS (SELECT k, median(score) AS m FROM g GROUP BY k), d AS (SELECT g.*, m FROM g JOIN m ON m.k IS NOT DISTINCT FROM g.k)
    SELECT k, round(any_value(m), 4) AS median, arg_min(event_id, (abs(score - m), event_id)) FILTER (score IS NOT NULL) AS representative, arg_min(event_id, (-score, event_id)) FILTER (score IS NOT NULL) AS extreme FROM d GROUP BY k
""")
def representative_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.representative_and_extreme(_with_gaps(spark, sf_dir), ["k"], "score", "event_id"), 4, "median")


@query(f"""
    WITH {_GAPS}, c AS (SELECT k, count(*) AS checkpoints, max(event_id) AS latest, arg_min(event_id, (score, event_id)) FILTER (score IS NOT NULL) AS best FROM g GROUP BY k)
    SELECT *, checkpoints - CASE WHEN coalesce(latest = best, true) THEN 1 ELSE 2 END AS prunable FROM c
""")
def pointers_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.pointers(_with_gaps(spark, sf_dir), "k", "event_id", "score")


@query(f"WITH {_GAPS} SELECT k, event_id, count(score) OVER (PARTITION BY k ORDER BY seconds, event_id) AS scored FROM g")
def running_with_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.running(_with_gaps(spark, sf_dir), ["k"], "seconds", 86_400, ["seconds", "event_id"], {"scored": F.when(F.col("score").isNotNull(), 1).otherwise(0)})
    return rows.select("k", "event_id", "scored")


@query("""
    SELECT x.c_mktsegment, round(min(power((x.c_acctbal - y.c_acctbal) / 10000, 2) + power((x.c_nationkey - y.c_nationkey) / 25.0::DOUBLE, 2)), 12) AS least_distance2
    FROM customer x LEFT JOIN customer y ON x.c_mktsegment = y.c_mktsegment AND x.c_custkey < y.c_custkey GROUP BY 1
""")
def closest_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least distance between two customers of each segment."""
    points = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", (F.col("c_acctbal") / 10_000).alias("a"), (F.col("c_nationkey") / 25).alias("b"))
    return rounded(sampling.closest_pairs(points, "c_mktsegment", "c_custkey", ["a", "b"]), 12, "least_distance2")


@query("""
    SELECT CASE event_id % 7 WHEN 0 THEN 'repeated key' WHEN 1 THEN 'number is not finite' WHEN 2 THEN 'not an object' WHEN 3 THEN 'not JSON' WHEN 4 THEN 'number is too long' WHEN 5 THEN 'missing'
                ELSE CASE WHEN json_valid(props) THEN 'read' ELSE 'not JSON' END END AS status, count(*) AS n
    FROM events GROUP BY 1
""")
def strict_json_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of which six of seven have a fault put in, counted by what a strict reader says of them."""
    of, rest = F.col("event_id") % 7, F.expr("substring(props, 2)")
    text = F.when(of == 0, F.concat(F.lit('{"x":1,"x":2,'), rest)).when(of == 1, F.concat(F.lit('{"y":NaN,'), rest)).when(of == 2, F.concat(F.lit("["), "props", F.lit("]")))
    text = text.when(of == 3, F.concat("props", F.lit("}"))).when(of == 4, F.concat(F.lit('{"z":'), F.repeat(F.lit("7"), 5000), F.lit(","), rest)).when(of == 6, F.col("props"))
    said = strict_objects(table(spark, sf_dir, "events").select(text.alias("text")), "text")
    return said.groupBy(F.coalesce("refused", F.lit("read")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT c_custkey, sha256('{"account":{"balance":"' || CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) || '","open":' || CASE WHEN c_acctbal >= 0 THEN 'true' ELSE 'false' END || '},"keys":[' || c_custkey || ',null,' || c_nationkey
           || '],"marks":{"a":' || c_nationkey % 3 || ',"b":null},"name":"' || c_name || '","zip":null}') AS row_id FROM customer
""")
def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of nested rows: structs, arrays, maps and nulls in one canonical text."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.struct(
            F.lit(None).cast("string").alias("zip"),
            F.col("c_name").alias("name"),
            F.create_map(F.lit("b"), F.lit(None).cast("int"), F.lit("a"), F.col("c_nationkey") % 3).alias("marks"),
            F.array(F.col("c_custkey"), F.lit(None).cast("long"), F.col("c_nationkey").cast("long")).alias("keys"),
            F.struct((F.col("c_acctbal") >= 0).alias("open"), F.col("c_acctbal").cast("decimal(12,2)").alias("balance")).alias("account"),
        ).alias("row"),
    )
    return rows.select("c_custkey", F.sha2(scalar.canonical_value(F.col("row"), rows.schema["row"].dataType), 256).alias("row_id"))
