"""Queries on keyed state, and on machines over it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.cut import shared_folder
from millrace.operators.sweeps import Sweep
from millrace.plans.sql import _EVENTS
from millrace.plans.tables import event_rows, table
from millrace.sources.epoch_sink import EpochSink
from millrace.sources.state_log import StateLog
from millrace.streaming.machines import Barrier, DayBudget, OperationTimer, Retention, run_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _fresh(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/millrace/{label}-{uuid.uuid4().hex}"


@query(f"""
    WITH {_EVENTS}, w AS (SELECT *, (seconds - (SELECT min(seconds) FROM e)) // 604800 AS week FROM e)
    SELECT user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, arg_max(event_type, event_id) AS last_type, count(DISTINCT week) AS revision FROM w GROUP BY user_id
""")
def keyed_state_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of users from a log of weekly commits, each sent twice and counted once; a user's revision counts their weeks."""
    fields = [("user_id", T.LongType()), ("n", T.LongType()), ("ids", T.LongType()), ("last_id", T.LongType()), ("last_type", T.StringType())]
    log = StateLog(spark, _fresh(spark, "state"), ["user_id"], T.StructType([T.StructField(*f) for f in fields]))
    rows = event_rows(spark, sf_dir)
    first, last = rows.agg(F.min("seconds"), F.max("seconds")).first()
    week = F.floor((F.col("seconds") - F.lit(first)) / 604_800)

    def change(both: DataFrame) -> DataFrame:
        later = F.col("last_id").isNull() | (F.col("new_id") > F.col("last_id"))
        return both.select(
            "user_id",
            (F.coalesce("n", F.lit(0)) + F.col("more")).alias("n"),
            (F.coalesce("ids", F.lit(0)) + F.col("more_ids")).alias("ids"),
            F.when(later, F.col("new_id")).otherwise(F.col("last_id")).alias("last_id"),
            F.when(later, F.col("new_type")).otherwise(F.col("last_type")).alias("last_type"),
            "revision",
        )

    for k in range((last - first) // 604_800 + 1 if first is not None else 0):
        own = rows.filter(week == k).groupBy("user_id")
        own = own.agg(F.count(F.lit(1)).alias("more"), F.sum("event_id").alias("more_ids"), F.max("event_id").alias("new_id"), F.max_by("event_type", "event_id").alias("new_type"))
        for _ in range(2):
            log.update(own, change, writer="weekly", batch=k)
    return log.snapshot().select("user_id", "n", "ids", "last_type", "revision")


@query(f"""
    WITH {_EVENTS}, w AS (SELECT *, (seconds - (SELECT min(seconds) FROM e)) // 604800 AS epoch FROM e)
    SELECT epoch, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM w GROUP BY epoch, event_type
""")
def epoch_sink_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by week in a sink: each week is sent twice and written once, and one that was taken back is sent again."""
    rows = event_rows(spark, sf_dir)
    first, last = rows.agg(F.min("seconds"), F.max("seconds")).first()
    own = rows.select(F.floor((F.col("seconds") - F.lit(first)) / 604_800).alias("week"), "event_id", "event_type")
    sink = EpochSink(spark, _fresh(spark, "sink"), own.drop("week").schema)
    weeks = (last - first) // 604_800 + 1 if first is not None else 0
    for k in range(weeks):
        for _ in range(2):
            sink.write(own.filter(F.col("week") == k).drop("week"), k)
    if weeks:
        sink.roll_back(weeks - 2)
        sink.write(own.filter(F.col("week") == weeks - 1).drop("week"), weeks - 1)
    return sink.read().groupBy("epoch", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("""
    SELECT CAST(s_suppkey AS VARCHAR) AS case_id,
           CASE WHEN s_suppkey % 3 = 0 THEN 'succeeded' WHEN s_suppkey % 3 = 1 THEN 'pending' ELSE 'failed' END AS state,
           CASE WHEN s_suppkey % 3 = 2 THEN 3 ELSE 2 END AS attempt,
           CASE WHEN s_suppkey % 3 = 0 THEN sha256(s_name) END AS run_digest,
           CASE WHEN s_suppkey % 3 = 0 THEN 'LEASE_EXPIRED' WHEN s_suppkey % 3 = 1 THEN 'LEASE_EXPIRED,BROKEN' ELSE 'LEASE_EXPIRED,BROKEN,LEASE_EXPIRED' END AS failure_codes,
           CASE WHEN s_suppkey % 3 = 0 THEN 5 WHEN s_suppkey % 3 = 1 THEN 5 ELSE 7 END AS revision
    FROM supplier
""")
def sweep_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each supplier: a lease that runs out, a second attempt that a third of them finish, a third one for another third."""
    cases = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").cast("string").alias("case_id"), F.sha2("s_name", 256).alias("run_digest"))
    at = lambda minute: f"2024-01-01 00:{minute:02d}:00"
    asked = lambda attempt, rows: rows.select("k", "case_id", F.lit(attempt).alias("attempt_id"), F.lit("worker").alias("lease_owner"), "run_digest", F.lit("BROKEN").alias("error_code"))
    sweep = Sweep(spark, _fresh(spark, "sweep"))
    sweep.initialize(cases, at(0))
    sweep.claim(asked("a1", cases), at(0))
    sweep.claim(asked("a2", cases), at(15))
    sweep.succeed(asked("a2", cases.filter("k % 3 = 0")), at(20))
    sweep.fail(asked("a2", cases.filter("k % 3 <> 0")), at(20))
    sweep.claim(asked("a3", cases.filter("k % 3 = 2")), at(21))
    sweep.reap(at(40))
    return sweep.cases().select("case_id", "state", "attempt", "run_digest", F.array_join("failure_codes", ",").alias("failure_codes"), "revision")


# -- machines in order of time


@query(f"""
    WITH RECURSIVE {_EVENTS}, r AS (
        SELECT seconds // 86400 AS day, event_id, user_id, seconds, 60 + event_id % 7 * 60 AS cost, event_type = 'error' AS closed,
               row_number() OVER (PARTITION BY seconds // 86400 ORDER BY seconds, event_id) AS n FROM e
    ), walk(day, n, event_id, reason, taken, reserved, held) AS (
        SELECT DISTINCT day, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, MAP {{}}::MAP(BIGINT, DOUBLE[]) FROM r
        UNION ALL
        SELECT day, n, event_id, reason, taken + CASE WHEN reason IS NULL THEN 1 ELSE 0 END, reserved + CASE WHEN reason IS NULL THEN cost ELSE 0 END,
               CASE WHEN reason IS NULL OR reason = 'rate' THEN map_concat(held, MAP {{user_id: [CASE WHEN reason IS NULL THEN tokens - 1 ELSE tokens END, seconds]}}) ELSE held END
        FROM (SELECT *, CASE WHEN closed THEN 'closed' WHEN taken >= 20 THEN 'count' WHEN reserved + cost > 3600 THEN 'seconds' WHEN tokens < 1 - 1e-9 THEN 'rate' END AS reason
              FROM (SELECT r.day, r.n, r.event_id, r.user_id, r.seconds::DOUBLE AS seconds, r.cost, r.closed, w.taken, w.reserved, w.held,
                           least(1.0::DOUBLE, coalesce(map_extract(w.held, r.user_id)[1][1], 1.0) + (r.seconds - coalesce(map_extract(w.held, r.user_id)[1][2], r.seconds)) / 7200.0) AS tokens
                    FROM walk w JOIN r ON r.day = w.day AND r.n = w.n + 1))
    )
    SELECT day, event_id AS sequence, reason IS NULL AS admitted, reason FROM walk WHERE n > 0
""")
def budget_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's requests, refused as closed, over the day's number, over its seconds, or over the client's rate, in this order."""
    rows = event_rows(spark, sf_dir).select(
        F.floor(F.col("seconds") / 86_400).alias("day"), "seconds", "event_id", F.col("user_id").alias("client"), (60 + F.col("event_id") % 7 * 60).alias("cost"), (F.col("event_type") == "error").alias("closed")
    )
    return run_table(rows, "day", "seconds", "event_id", DayBudget(most=20, seconds=3600, capacity=1, window=7200))


@query(f"""
    WITH {_EVENTS}, j AS (
        SELECT user_id, event_id, seconds, lead(seconds, 3) OVER (PARTITION BY user_id ORDER BY seconds, event_id) AS pushed FROM e WHERE event_type IN ('purchase', 'error', 'view')
    ), said AS (
        SELECT user_id, CAST(event_id AS VARCHAR) AS job, CASE WHEN pushed < seconds + 86400 THEN pushed ELSE seconds + 86400 END::DOUBLE AS removed_at,
               CASE WHEN pushed < seconds + 86400 THEN 'trimmed' ELSE 'expired' END AS why FROM j
    )
    SELECT * FROM said WHERE why = 'trimmed' OR removed_at <= (SELECT max(seconds) FROM e)
""")
def retention_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ended jobs of each user that went: after a day, or earlier because three others had come."""
    rows = event_rows(spark, sf_dir)
    until = rows.agg(F.max("seconds")).first()[0]
    ended = rows.filter(F.col("event_type").isin("purchase", "error", "view")).select("user_id", "seconds", "event_id", F.col("event_id").cast("string").alias("job"))
    return run_table(ended, "user_id", "seconds", "event_id", Retention(ttl=86_400, capacity=3), until=until)


@query(f"""
    WITH {_EVENTS}, r AS (
        SELECT user_id, event_type AS member, seconds, event_id % 10 < 9 AS identity, row_number() OVER w AS n, first_value(seconds) OVER w AS t0, first_value(event_id % 10 < 9) OVER w AS id0
        FROM e WINDOW w AS (PARTITION BY user_id ORDER BY seconds, event_id)
    ), timely AS (SELECT * FROM r WHERE seconds < t0 + 172800),
    other AS (SELECT user_id, min(n) AS n FROM timely WHERE identity <> id0 GROUP BY 1),
    firsts AS (SELECT user_id, member, min(n) AS n FROM timely WHERE identity = id0 GROUP BY 1, 2),
    third AS (SELECT user_id, n FROM firsts QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n) = 4),
    ends AS (
        SELECT u.user_id, u.t0, CASE WHEN o.n < coalesce(t.n, o.n + 1) THEN 'mismatch' WHEN t.n IS NOT NULL THEN 'complete' ELSE 'timeout' END AS result, least(o.n, t.n) AS n
        FROM (SELECT DISTINCT user_id, t0 FROM r) u LEFT JOIN other o ON o.user_id = u.user_id LEFT JOIN third t ON t.user_id = u.user_id
    )
    SELECT e.user_id, result, CASE WHEN result = 'timeout' THEN e.t0 + 172800 ELSE r.seconds END::DOUBLE AS decided_at,
           (SELECT count(*) FROM firsts f WHERE f.user_id = e.user_id AND (e.n IS NULL OR f.n < e.n OR (f.n = e.n AND result = 'complete'))) AS members
    FROM ends e LEFT JOIN r ON r.user_id = e.user_id AND r.n = e.n
""")
def barrier_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user whether four kinds of events came within two days of the first one, all with its identity."""
    rows = event_rows(spark, sf_dir)
    identity = F.when(F.col("event_id") % 10 < 9, "same").otherwise("other")
    return run_table(rows.select("user_id", "seconds", "event_id", F.col("event_type").alias("member"), identity.alias("identity")), "user_id", "seconds", "event_id", Barrier(needed=4, deadline=172_800))


@query(f"""
    WITH RECURSIVE {_EVENTS}, r AS (
        SELECT user_id, event_id, seconds, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS op, row_number() OVER (PARTITION BY user_id ORDER BY seconds, event_id) AS n
        FROM e WHERE event_type IN ('signup', 'purchase', 'error')
    ), walk(user_id, n, began, start, over, sequence, outcome, took) AS (
        SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::DOUBLE FROM r
        UNION ALL
        SELECT user_id, n, CASE WHEN op = 'start' THEN CASE WHEN live THEN began ELSE seconds END END, CASE WHEN op = 'start' THEN CASE WHEN live THEN start ELSE event_id END END,
               CASE WHEN began IS NOT NULL AND NOT live THEN start END, CASE WHEN op = 'start' AND NOT live THEN NULL WHEN op <> 'start' AND live THEN start ELSE event_id END,
               CASE WHEN op = 'start' THEN 'overlap' WHEN live THEN op ELSE 'no start' END, CASE WHEN op <> 'start' AND live THEN seconds - began END::DOUBLE
        FROM (SELECT r.*, w.began, w.start, w.began IS NOT NULL AND w.began + 172800 > r.seconds AS live FROM walk w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1)
    )
    SELECT user_id, sequence, outcome, took FROM walk WHERE n > 0 AND sequence IS NOT NULL
    UNION ALL SELECT user_id, over, 'expired', 172800.0::DOUBLE FROM walk WHERE over IS NOT NULL
    UNION ALL SELECT user_id, start, 'expired', 172800.0::DOUBLE FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1) WHERE start IS NOT NULL
""")
def operation_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One operation of a user at a time: how it ended, or that two days passed; starts in between and ends without a start are refused."""
    rows = event_rows(spark, sf_dir).filter(F.col("event_type").isin("signup", "purchase", "error"))
    op = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "done").otherwise("failed")
    return run_table(rows.select("user_id", "seconds", "event_id", op.alias("op")), "user_id", "seconds", "event_id", OperationTimer(limit=172_800))
