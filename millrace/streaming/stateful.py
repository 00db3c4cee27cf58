"""The same machines on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.streaming.folds import Bucket, Lease, lease_step, take


def token_bucket_stream(requests: DataFrame, key: str, at: str, tie: str, capacity: int, window: float, lateness: str = "10 minutes") -> DataFrame:
    """key, tie, admitted, retry_after for a stream of requests with an event time; a bucket at rest for a window is dropped.

    Requests older than their bucket's last one are late: they are refused with retry_after -1.
    """
    types = dict(requests.dtypes)

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = Bucket(*state.get) if state.exists else Bucket(float(capacity))
        rows = pd.concat(list(batches)).sort_values([at, tie])
        out = []
        for moment, which in zip(rows[at], rows[tie], strict=True):
            now = pd.Timestamp(moment).timestamp()
            said = (False, -1) if bucket.at is not None and now < bucket.at else take(bucket, now, capacity, window)
            out.append((keys[0], which, *said))
        state.update((bucket.tokens, bucket.at))
        rest = int((bucket.at + window) * 1000)
        state.setTimeoutTimestamp(max(rest, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, tie, "admitted", "retry_after"])

    schema = f"`{key}` {types[key]}, `{tie}` {types[tie]}, admitted boolean, retry_after bigint"
    rows = requests.select(key, at, tie).withWatermark(at, lateness)
    return rows.groupBy(key).applyInPandasWithState(step, schema, "tokens double, at double", "append", GroupStateTimeout.EventTimeTimeout)


def lease_stream(events: DataFrame, *, minutes: float = 10, most_attempts: int = 3, lateness: str = "10 minutes", keep: str = "1 hour") -> DataFrame:
    """What lease_replay() says, for a stream of events (case_id, sequence, at, op, owner, digest, code, attempt) with an event time.

    A lease whose time the watermark has passed expires by itself, told by a row without a sequence and the
    result 'expired'; a case that ended is forgotten after `keep`. Events older than the watermark are late and dropped.
    """
    columns = ["sequence", "at", "op", "owner", "digest", "code", "attempt"]
    kept = pd.Timedelta(keep).total_seconds()

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lease, last = Lease(), 0.0
        if state.exists:
            *held, codes, last = state.get
            lease = Lease(*held, failures=[c for c in codes.split(",") if c])
        out = []

        def tell(sequence: int | None, result: str) -> None:
            out.append((keys[0], sequence, result, lease.state, lease.attempt, ",".join(lease.failures)))

        if state.hasTimedOut:
            if lease.state != "running":
                state.remove()
                return
            last = lease.expires
            lease_step(lease, "reap", None, last, minutes=minutes, most_attempts=most_attempts)
            tell(None, "expired")
        else:
            rows = pd.concat(list(batches)).sort_values(["at", "sequence"]).astype(object)
            for sequence, at, op, owner, digest, code, attempt in rows.where(rows.notna(), None)[columns].itertuples(index=False):
                last = pd.Timestamp(at).timestamp()
                tell(sequence, lease_step(lease, op, owner, last, minutes=minutes, most_attempts=most_attempts, digest=digest, code=code, attempt=attempt))
        state.update((lease.state, lease.attempt, lease.owner, lease.expires, lease.digest, ",".join(lease.failures), last))
        # A pending case is open: it has no end to wait for.
        until = lease.expires if lease.state == "running" else last + kept if lease.state in ("succeeded", "failed") else None
        if until is not None:
            state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["case_id", "sequence", "result", "state", "attempt", "failure_codes"])

    rows = events.select("case_id", *columns).withWatermark("at", lateness)
    kind = dict(events.dtypes)["case_id"]
    held = "state string, attempt bigint, owner string, expires double, digest string, codes string, last double"
    out = f"case_id {kind}, sequence bigint, result string, state string, attempt bigint, failure_codes string"
    return rows.groupBy("case_id").applyInPandasWithState(step, out, held, "append", GroupStateTimeout.EventTimeTimeout)


def first_submissions(stream: DataFrame, key: str, at: str, lateness: str = "1 hour") -> DataFrame:
    """The first row of each key while its watermark lasts."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, kind: str, width: str, lateness: str) -> DataFrame:
    """window start, kind, n, closed once the watermark passes."""
    counted = stream.withWatermark(at, lateness).groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), kind, "n")
