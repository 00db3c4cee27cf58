"""Keyed state machines as folds over rows sorted by key and time.

The rows of a key are read one after the other in one task and only its state is held, so a key may have
any number of rows. What a state machine says of a row depends on all rows before it, so a key is not split.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def fold(df: DataFrame, key: str, order: Sequence[str], start: Callable[[], object], step: Callable[..., tuple], schema: T.StructType) -> DataFrame:
    """One row out for each row in: step(state, *columns of df) changes the key's state and gives the row's values."""
    place, kinds, names = df.columns.index(key), [to_arrow_type(f.dataType) for f in schema], schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, fresh = None, None, True
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fresh or row[place] != own:
                    own, state, fresh = row[place], start(), False
                out.append(step(state, *row))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _schema(df: DataFrame, kept: Sequence[str], more: str) -> T.StructType:
    return T.StructType([*[df.schema[c] for c in kept], *T.StructType.fromDDL(more)])


@dataclass
class Bucket:
    tokens: float
    at: float | None = None


def take(bucket: Bucket, now: float, capacity: int, window: float) -> tuple[bool, int]:
    """Whether a request is let in, and else after how many seconds it may come again."""
    if bucket.at is not None and now < bucket.at:
        raise ValueError("time goes backwards")
    if bucket.at is not None:
        bucket.tokens = min(float(capacity), bucket.tokens + (now - bucket.at) * capacity / window)
    bucket.at = now
    if bucket.tokens >= 1 - 1e-9:
        bucket.tokens -= 1
        return True, 0
    return False, math.ceil((1 - bucket.tokens) * window / capacity - 1e-9)


def token_bucket(requests: DataFrame, key: str, seconds: str, tie: str, capacity: int, window: float) -> DataFrame:
    """key, tie, admitted, retry_after for each request; seconds is a number."""
    rows = requests.select(key, tie, F.col(seconds).cast("double").alias(seconds))

    def step(bucket: Bucket, own: object, which: object, now: float) -> tuple:
        return own, which, *take(bucket, now, capacity, window)

    return fold(rows, key, [seconds, tie], lambda: Bucket(float(capacity)), step, _schema(requests, [key, tie], "admitted boolean, retry_after bigint"))


@dataclass
class Lease:
    state: str = "pending"
    attempt: int = 0
    owner: str | None = None
    expires: float | None = None
    digest: str | None = None
    failures: list = field(default_factory=list)


def lease_step(lease: Lease, op: str, owner: str | None, now: float, *, minutes: float, most_attempts: int, digest: str | None = None, code: str | None = None, attempt: int | None = None) -> str:
    """Apply one operation: 'ok', 'same' for what was done before, or why it is refused."""
    if lease.state == "running" and now >= lease.expires:
        lease.failures.append("LEASE_EXPIRED")
        lease.owner = lease.expires = None
        lease.state = "failed" if lease.attempt >= most_attempts else "pending"
    if op == "reap":
        return "ok"
    if op == "claim":
        if lease.state != "pending":
            return f"refused: {lease.state}"
        lease.state, lease.attempt, lease.owner, lease.expires = "running", lease.attempt + 1, owner, now + 60 * minutes
        return "ok"
    if op == "succeed" and lease.state == "succeeded":
        return "same" if digest == lease.digest else "refused: other digest"
    if lease.state != "running" or owner != lease.owner:
        return "refused: no lease"
    if attempt is not None and attempt != lease.attempt:
        return "refused: other attempt"
    if op == "renew":
        lease.expires = now + 60 * minutes
    elif op == "succeed":
        lease.state, lease.digest, lease.owner, lease.expires = "succeeded", digest, None, None
    elif op == "fail":
        lease.failures.append(code or "FAILED")
        lease.owner = lease.expires = None
        lease.state = "failed" if lease.attempt >= most_attempts else "pending"
    else:
        return "refused: unknown operation"
    return "ok"


def lease_replay(events: DataFrame, *, minutes: float = 10, most_attempts: int = 3) -> DataFrame:
    """case_id, sequence, result, state, attempt, failure_codes for events (case_id, sequence, seconds, op, owner, digest, code, attempt).

    An event that names its attempt is refused where another one holds the lease.
    """
    columns = ["case_id", "sequence", "seconds", "op", "owner", "digest", "code", "attempt"]
    rows = events if "attempt" in events.columns else events.withColumn("attempt", F.lit(None).cast("long"))

    def step(lease: Lease, case: object, sequence: int, now: float, op: str, owner: str | None, digest: str | None, code: str | None, attempt: int | None) -> tuple:
        said = lease_step(lease, op, owner, float(now), minutes=minutes, most_attempts=most_attempts, digest=digest, code=code, attempt=attempt)
        return case, sequence, said, lease.state, lease.attempt, ",".join(lease.failures)

    schema = _schema(events, ["case_id", "sequence"], "result string, state string, attempt bigint, failure_codes string")
    return fold(rows.select(*columns), "case_id", ["seconds", "sequence"], Lease, step, schema)
