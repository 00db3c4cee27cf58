"""A sweep's cases as leases in a state log: whole tables of requests are judged at once.

A case is pending, running (one attempt holds a lease), succeeded or failed. Each transition is a commit of all
cases that it moves, so another driver that moves one of them meanwhile makes it start again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.cut import checkpointed
from millrace.sources.state_log import REVISION, StateLog

_KINDS = {"attempt": T.LongType(), "lease_expires_at": T.TimestampType(), "failure_codes": T.ArrayType(T.StringType()), "updated_at": T.TimestampType()}
_NAMES = ["case_id", "state", "attempt", "attempt_id", "lease_owner", "lease_expires_at", "run_digest", "error_code", "failure_codes", "updated_at"]
CASE = T.StructType([T.StructField(n, _KINDS.get(n, T.StringType())) for n in _NAMES])
# Fixed values.
MOST_ATTEMPTS, LEASE_MINUTES, LEASE_EXPIRED = 3, 10, "LEASE_EXPIRED"


class Sweep:
    """The cases of one sweep. Times are given, so that a replay says the same."""

    def __init__(self, spark: SparkSession, path: str, *, most_attempts: int = MOST_ATTEMPTS, minutes: float = LEASE_MINUTES):
        self.log = StateLog(spark, path, ["case_id"], CASE)
        self.most_attempts, self.seconds = most_attempts, int(60 * minutes)

    def cases(self) -> DataFrame:
        return self.log.snapshot()

    def _moved(self, rows: DataFrame, **values: Column) -> DataFrame:
        """rows with new values for some columns of the state and the others as they are."""
        return rows.select("case_id", *[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in CASE.fields if f.name != "case_id"], REVISION)

    def initialize(self, cases: DataFrame, now: str) -> int:
        """Pending states of the cases that have none yet."""
        fresh = lambda rows: self._moved(
            rows.filter(F.col(REVISION).isNull()), state=F.lit("pending"), attempt=F.lit(0), failure_codes=F.expr("cast(array() as array<string>)"), updated_at=F.lit(now)
        )
        return self.log.update(cases.select("case_id").distinct(), fresh)

    def _freed(self, rows: DataFrame, now: Column, code: Column) -> DataFrame:
        """A lease ends without a result: the case is pending again, or failed after its last attempt."""
        return self._moved(
            rows,
            state=F.when(F.col("attempt") >= self.most_attempts, "failed").otherwise("pending"),
            lease_owner=F.lit(None),
            lease_expires_at=F.lit(None),
            error_code=code,
            failure_codes=F.array_append("failure_codes", code),
            updated_at=now,
        )

    def reap(self, now: str) -> int:
        """End the leases whose time is over."""
        at = F.lit(now).cast("timestamp")
        over = self.cases().filter((F.col("state") == "running") & (F.col("lease_expires_at") <= at)).select("case_id")
        still = lambda rows: rows.filter((F.col("state") == "running") & (F.col("lease_expires_at") <= at))
        return self.log.update(over, lambda rows: self._freed(still(rows), at, F.lit(LEASE_EXPIRED)))

    def claim(self, requests: DataFrame, now: str) -> DataFrame:
        """case_id, asked_by, result for requests (case_id, attempt_id, lease_owner).

        Of several requests for one case the one with the least attempt_id is heard. Results: 'claimed', 'held' (by
        this attempt already), 'busy', 'other owner' (the attempt is bound to one), 'used' (the attempt ended before),
        'not pending', 'unknown'.
        """
        self.reap(now)
        at = F.lit(now).cast("timestamp")
        one = requests.groupBy("case_id").agg(F.min_by(F.struct("attempt_id", "lease_owner"), F.struct("attempt_id", "lease_owner")).alias("r"))
        asked = one.select("case_id", F.col("r.attempt_id").alias("asked_by"), F.col("r.lease_owner").alias("asker"))
        result = (
            F.when(F.col(REVISION).isNull(), "unknown")
            .when((F.col("state") == "running") & (F.col("attempt_id") == F.col("asked_by")) & (F.col("lease_owner") == F.col("asker")), "held")
            .when((F.col("state") == "running") & (F.col("attempt_id") == F.col("asked_by")), "other owner")
            .when(F.col("state") == "running", "busy")
            .when(F.col("state") != "pending", "not pending")
            .when(F.col("attempt_id") == F.col("asked_by"), "used")
            .otherwise("claimed")
        )

        def change(rows: DataFrame) -> DataFrame:
            return self._moved(
                rows.filter(result == "claimed"),
                state=F.lit("running"),
                attempt=F.col("attempt") + 1,
                attempt_id=F.col("asked_by"),
                lease_owner=F.col("asker"),
                lease_expires_at=at + F.make_interval(secs=F.lit(self.seconds)),
                run_digest=F.lit(None),
                error_code=F.lit(None),
                updated_at=at,
            )

        return self._said(asked, result, change)

    def _said(self, asked: DataFrame, result: Column, change) -> DataFrame:
        """Judge requests and commit what they change; the judgement is that of the state the change was made from."""
        told: list[DataFrame] = []

        def both(rows: DataFrame) -> DataFrame:
            judged = checkpointed(rows.withColumn("result", result))
            told[:] = [judged.select("case_id", "asked_by", "result")]
            return change(judged)

        self.log.update(asked, both)
        return told[0]

    def _finish(self, requests: DataFrame, now: str, more: str, values, same: Column | None = None) -> DataFrame:
        at = F.lit(now).cast("timestamp")
        asked = requests.select("case_id", F.col("attempt_id").alias("asked_by"), F.col("lease_owner").alias("asker"), F.col(more).alias("given"))
        holds = (F.col("state") == "running") & (F.col("attempt_id") == F.col("asked_by")) & (F.col("lease_owner") == F.col("asker")) & (F.col("lease_expires_at") > at)
        result = F.when(F.coalesce(holds, F.lit(False)) & (F.col("updated_at") <= at), "ok")
        if same is not None:
            ended = (F.col("state") == "succeeded") & (F.col("attempt_id") == F.col("asked_by"))
            result = result.when(ended & same, "same").when(ended, "other digest")
        return self._said(asked, result.otherwise("no lease"), lambda rows: values(rows.filter("result = 'ok'"), at))

    def renew(self, requests: DataFrame, now: str) -> DataFrame:
        """case_id, asked_by, result ('ok', 'no lease') for requests (case_id, attempt_id, lease_owner)."""
        longer = lambda rows, at: self._moved(rows, lease_expires_at=at + F.make_interval(secs=F.lit(self.seconds)), updated_at=at)
        return self._finish(requests.withColumn("__none", F.lit(None).cast("string")), now, "__none", longer)

    def succeed(self, requests: DataFrame, now: str) -> DataFrame:
        """As renew(), with run_digest; 'same' if the attempt succeeded with this digest before, 'other digest' if with another."""
        done = lambda rows, at: self._moved(
            rows, state=F.lit("succeeded"), lease_owner=F.lit(None), lease_expires_at=F.lit(None), run_digest=F.col("given"), updated_at=at
        )
        return self._finish(requests, now, "run_digest", done, F.col("run_digest").eqNullSafe(F.col("given")))

    def fail(self, requests: DataFrame, now: str) -> DataFrame:
        """As renew(), with error_code."""
        return self._finish(requests, now, "error_code", lambda rows, at: self._freed(rows, at, F.coalesce("given", F.lit("FAILED"))))
