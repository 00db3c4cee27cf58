"""Machines over events in order of time, the same on tables and on streams.

A machine says what follows from an event and from time that passes; it keeps one small value and a map for each
key through a Store. On a table (run_table) the rows of a key are read one after the other in one task. On a
stream (run_stream, transformWithState) rows wait in state until the watermark has passed them, so that they are
judged in order of time whatever order and micro-batches they come in; timers wake the machine. Rows are handed
over one by one: neither a key's rows nor its micro-batch are ever held together, only its state is.

At one moment what is due by then comes first, then the rows of that moment in order of their sequence. Rows that
are older than the watermark are late: they are told as such and change nothing. Rows without a time are left out.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATE = "late"


class Store:
    """A key's state in memory: one value and a map."""

    def __init__(self):
        self.value: dict = {}
        self.map: dict[str, list] = {}

    def get(self) -> dict:
        return self.value

    def put(self, value: dict) -> None:
        self.value = value

    def entry(self, key: object) -> list | None:
        return self.map.get(str(key))

    def put_entry(self, key: object, value: list) -> None:
        self.map[str(key)] = value

    def remove_entry(self, key: object) -> None:
        self.map.pop(str(key), None)


class Machine:
    """columns: what an event brings besides key, time and sequence; out: what is told, as (name, type) pairs.

    horizon: after how many seconds an event may have an end of its own, if it may.
    """

    columns: list[str] = []
    out: list[tuple[str, T.DataType]] = []
    horizon: float | None = None

    def due(self, store: Store, now: float) -> Iterator[tuple]:
        """What has come to its end by now, in order of time."""
        return iter(())

    def step(self, store: Store, at: float, sequence: int, row: tuple) -> Iterator[tuple]:
        raise NotImplementedError

    def late(self, at: float, sequence: int, row: tuple) -> tuple:
        raise NotImplementedError


_LONG, _TEXT, _REAL, _FLAG = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()


@dataclass
class DayBudget(Machine):
    """Requests of a day: refused as 'closed', 'count', 'seconds' or 'rate', in this order; the key is the day.

    Events bring client, cost and closed. What is refused costs nothing. A client's bucket is full at its first
    request of the day.
    """

    most: int
    seconds: float
    capacity: int
    window: float
    columns = ["client", "cost", "closed"]
    out = [("sequence", _LONG), ("admitted", _FLAG), ("reason", _TEXT)]

    def step(self, store: Store, at: float, sequence: int, row: tuple) -> Iterator[tuple]:
        client, cost, closed = row
        held = store.get()
        n, reserved = held.get("n", 0), held.get("reserved", 0)
        if closed:
            yield sequence, False, "closed"
        elif n >= self.most:
            yield sequence, False, "count"
        elif reserved + cost > self.seconds:
            yield sequence, False, "seconds"
        else:
            tokens, last = store.entry(client) or [float(self.capacity), at]
            tokens = min(float(self.capacity), tokens + (at - last) * self.capacity / self.window)
            ok = tokens >= 1 - 1e-9
            store.put_entry(client, [tokens - 1 if ok else tokens, at])
            if ok:
                store.put({"n": n + 1, "reserved": reserved + cost})
            yield sequence, ok, None if ok else "rate"

    def late(self, at: float, sequence: int, row: tuple) -> tuple:
        return sequence, False, LATE


@dataclass
class Retention(Machine):
    """Ended jobs stay for ttl seconds, `capacity` of a key at most: the one that ended first goes. Events bring job."""

    ttl: float
    capacity: int
    columns = ["job"]
    out = [("job", _TEXT), ("removed_at", _REAL), ("why", _TEXT)]

    @property
    def horizon(self) -> float:
        return self.ttl

    def _pop(self, store: Store, held: dict) -> list:
        first = store.entry(held["head"])
        store.remove_entry(held["head"])
        held["head"] += 1
        return first

    def due(self, store: Store, now: float) -> Iterator[tuple]:
        held = store.get()
        while held and held["head"] < held["tail"] and store.entry(held["head"])[0] + self.ttl <= now:
            ended, job = self._pop(store, held)
            yield job, ended + self.ttl, "expired"
        if held:
            store.put(held)

    def step(self, store: Store, at: float, sequence: int, row: tuple) -> Iterator[tuple]:
        held = store.get() or {"head": 0, "tail": 0}
        if held["tail"] - held["head"] >= self.capacity:
            _, job = self._pop(store, held)
            yield job, at, "trimmed"
        store.put_entry(held["tail"], [at, row[0]])
        held["tail"] += 1
        store.put(held)

    def late(self, at: float, sequence: int, row: tuple) -> tuple:
        return row[0], at, LATE


@dataclass
class Barrier(Machine):
    """One result a key: 'complete' with the last of `needed` members, 'mismatch' with the first member of another

    identity than the first one's, or 'timeout' when `deadline` seconds have passed. Events bring member and identity.
    """

    needed: int
    deadline: float
    columns = ["member", "identity"]
    out = [("result", _TEXT), ("decided_at", _REAL), ("members", _LONG)]

    @property
    def horizon(self) -> float:
        return self.deadline

    def due(self, store: Store, now: float) -> Iterator[tuple]:
        held = store.get()
        if held and not held["over"] and held["first"] + self.deadline <= now:
            store.put({**held, "over": True})
            yield "timeout", held["first"] + self.deadline, held["n"]

    def step(self, store: Store, at: float, sequence: int, row: tuple) -> Iterator[tuple]:
        member, identity = row
        held = store.get()
        if not held:
            held = {"first": at, "identity": identity, "n": 0, "over": False}
        if not held["over"]:
            if identity != held["identity"]:
                held["over"] = True
                yield "mismatch", at, held["n"]
            elif store.entry(member) is None:
                store.put_entry(member, [at])
                held["n"] += 1
                if held["n"] >= self.needed:
                    held["over"] = True
                    yield "complete", at, held["n"]
        store.put(held)

    def late(self, at: float, sequence: int, row: tuple) -> tuple:
        return LATE, at, 0


@dataclass
class OperationTimer(Machine):
    """One operation of a key at a time. Events bring op: 'start', or another word that ends it.

    Told for each end, and for a start that is refused: the start's sequence, the outcome (the word of the end,
    'expired' after `limit` seconds, 'overlap', or 'no start') and how long it took.
    """

    limit: float
    columns = ["op"]
    out = [("sequence", _LONG), ("outcome", _TEXT), ("took", _REAL)]

    @property
    def horizon(self) -> float:
        return self.limit

    def due(self, store: Store, now: float) -> Iterator[tuple]:
        held = store.get()
        if held and held["at"] + self.limit <= now:
            store.put({})
            yield held["sequence"], "expired", float(self.limit)

    def step(self, store: Store, at: float, sequence: int, row: tuple) -> Iterator[tuple]:
        held = store.get()
        if row[0] == "start":
            if held:
                yield sequence, "overlap", None
            else:
                store.put({"at": at, "sequence": sequence})
        elif held:
            store.put({})
            yield held["sequence"], row[0], at - held["at"]
        else:
            yield sequence, "no start", None

    def late(self, at: float, sequence: int, row: tuple) -> tuple:
        return sequence, LATE, None


def run_table(events: DataFrame, key: str, at: str, sequence: str, machine: Machine, *, until: float | None = None) -> DataFrame:
    """key and what the machine tells; at is a number of seconds. What is due by `until` is told at the end (None: all)."""
    schema = T.StructType([events.schema[key], *[T.StructField(n, t) for n, t in machine.out]])
    kinds, names = [to_arrow_type(f.dataType) for f in schema], schema.fieldNames()
    end = math.inf if until is None else until

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, store, fresh = None, Store(), True
        for batch in batches:
            out = []
            for k, moment, which, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fresh or k != own:
                    if not fresh:
                        out += [(own, *said) for said in machine.due(store, end)]
                    own, store, fresh = k, Store(), False
                out += [(k, *said) for said in machine.due(store, moment)]
                out += [(k, *said) for said in machine.step(store, moment, which, tuple(row))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if rest := [] if fresh else [(own, *said) for said in machine.due(store, end)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rest, strict=True), kinds, strict=True)], names=names)

    rows = events.filter(F.col(at).isNotNull()).select(key, F.col(at).cast("double").alias(at), F.col(sequence).cast("long").alias(sequence), *machine.columns)
    return rows.repartition(key).sortWithinPartitions(key, at, sequence).mapInArrow(run, schema)


class _Held(Store):
    """A key's state in a stream's state store."""

    def __init__(self, value, entries):
        self.states, self.entries = value, entries

    def get(self) -> dict:
        return json.loads(self.states.get()[0]) if self.states.exists() else {}

    def put(self, value: dict) -> None:
        self.states.update((json.dumps(value),))

    def entry(self, key: object) -> list | None:
        found = self.entries.getValue((str(key),)) if self.entries.containsKey((str(key),)) else None
        return None if found is None else json.loads(found[0])

    def put_entry(self, key: object, value: list) -> None:
        self.entries.updateValue((str(key),), (json.dumps(value),))

    def remove_entry(self, key: object) -> None:
        self.entries.removeKey((str(key),))


class _Ordered(StatefulProcessor):
    """Lets rows wait for the watermark and hands them to a machine in order of time."""

    def __init__(self, machine: Machine, key: str, at: str, sequence: str, out: list[str]):
        self.machine, self.key, self.at, self.sequence, self.names = machine, key, at, sequence, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "moment bigint", "rows string")
        self.store = _Held(handle.getValueState("value", "held string"), handle.getMapState("entries", "name string", "held string"))

    def _told(self, key: object, said: Iterator[tuple]) -> Iterator[Row]:
        row = Row(*self.names)
        for values in said:
            yield row(key, *values)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        for r in rows:
            # Microseconds, so that the order within a millisecond is that of time too.
            micros = round(r[self.at] * 1_000_000)
            moment, own = -(-micros // 1000), [micros, r[self.sequence], [r[c] for c in self.machine.columns]]
            if moment <= passed:
                yield from self._told(key[0], iter([self.machine.late(micros / 1e6, own[1], tuple(own[2]))]))
                continue
            held = json.loads(self.waiting.getValue((moment,))[0]) if self.waiting.containsKey((moment,)) else []
            self.waiting.updateValue((moment,), (json.dumps([*held, own]),))
            self.handle.registerTimer(moment)
            if self.machine.horizon is not None:  # now, so that it stands in line before the watermark comes by
                self.handle.registerTimer(math.ceil((micros / 1e6 + self.machine.horizon) * 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        moment = expiredTimerInfo.getExpiryTimeInMs()
        rows = []
        if self.waiting.containsKey((moment,)):
            rows = sorted(json.loads(self.waiting.getValue((moment,))[0]), key=lambda r: r[:2])
            self.waiting.removeKey((moment,))
        for micros, sequence, values in rows:
            yield from self._told(key[0], self.machine.due(self.store, micros / 1e6))
            yield from self._told(key[0], self.machine.step(self.store, micros / 1e6, sequence, tuple(values)))
        yield from self._told(key[0], self.machine.due(self.store, moment / 1e3))

    def close(self) -> None:
        pass


def run_stream(events: DataFrame, key: str, at: str, sequence: str, machine: Machine, *, lateness: str = "10 minutes") -> DataFrame:
    """What run_table() tells, for a stream whose `at` is a timestamp; the session's state store must be RocksDB's.

    Told once the watermark has passed: the rows after the last watermark wait for later ones.
    """
    rows = events.filter(F.col(at).isNotNull()).withWatermark(at, lateness)
    # Seconds for the machine; the watermark stays with the timestamp.
    wanted = rows.select(key, at, (F.unix_micros(at) / 1_000_000).alias("__seconds"), F.col(sequence).cast("long").alias(sequence), *machine.columns)
    schema = T.StructType([events.schema[key], *[T.StructField(n, t) for n, t in machine.out]])
    processor = _Ordered(machine, key, "__seconds", sequence, schema.fieldNames())
    return wanted.groupBy(key).transformWithState(processor, schema, "Append", "EventTime")
