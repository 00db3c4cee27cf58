"""Keyed state with compare-and-set: a commit log of numbered entries over written changes.

A store is a folder. Changes are Parquet tables; a change takes effect when the entry that names it stands in
the log under the next number. An entry is written beside its place and put there only if the place is free,
so of two writers of one number one wins. The other reads what was committed meanwhile: if it touches none of
its keys, its entry takes the following number, otherwise its change is refused. Readers see whole entries only,
and a change whose writer dies is named by no entry. Entries hold no rows: the driver reads one short file for
each commit after the last compact().

Defined results: a null key is a key like others. A key may be changed once in a change; a change of no rows is a
commit of its own (its batch counts as written). A store without entries has no rows.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a store adds to the columns of its states.
REVISION, DELETED = "revision", "deleted"


class Conflict(Exception):
    """A change that was made for another revision than the current one."""


@dataclass(frozen=True)
class Entry:
    version: int
    data: str
    rows: int
    writer: str | None = None
    batch: int | None = None
    #: Whether data holds all states, so that earlier entries need not be read.
    whole: bool = False


class StateLog:
    """States of keys; `schema` is that of a state, with its key columns."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: T.StructType):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        if {REVISION, DELETED} & set(schema.fieldNames()):
            raise ValueError(f"{REVISION} and {DELETED} are the store's own columns")
        # What a file holds may be null, whatever a schema says.
        self.states = [f.name for f in schema.fields]
        self.schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in schema.fields], T.StructField(REVISION, T.LongType()), T.StructField(DELETED, T.BooleanType())])
        self._known: dict[int, Entry] = {}

    # -- the log

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self) -> list[Entry]:
        """All entries, in order. Those read before are not read again, since an entry never changes."""
        folder, system = self._place("log")
        if not system.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in system.listStatus(folder))
        versions = [int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit()]
        for v in versions:
            if v not in self._known:
                place, _ = self._place(f"log/{v:020d}.json")
                stream = system.open(place)
                try:
                    said = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
                self._known[v] = Entry(**said)
        if versions != list(range(1, len(versions) + 1)):
            raise ValueError(f"{self.path}: the log has gaps")
        return [self._known[v] for v in versions]

    def version(self) -> int:
        return len(self.entries())

    def _put(self, entry: Entry) -> bool:
        """Put an entry in its place, if that is free."""
        folder, system = self._place("log")
        system.mkdirs(folder)
        beside, _ = self._place(f"log/.{uuid.uuid4().hex}.tmp")
        target, _ = self._place(f"log/{entry.version:020d}.json")
        stream = system.create(beside, False)
        stream.write(bytearray(json.dumps(entry.__dict__).encode()))
        stream.close()
        try:
            if system.getScheme() == "file":
                # The rename of a local file system replaces what is there; a link does not.
                local = lambda p: unquote(urlparse(p.toUri().toString()).path)
                os.link(local(beside), local(target))
                return True
            context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
            none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = none
            context.rename(beside, target, options)
            return True
        except FileExistsError:
            return False
        except Exception as error:
            if "FileAlreadyExists" in str(error) or (isinstance(error, PySparkException) and system.exists(target)):
                return False
            raise
        finally:
            if system.exists(beside):
                system.delete(beside, False)

    # -- reading

    def _read(self, entry: Entry) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{entry.data}").withColumn("version", F.lit(entry.version).cast("long"))

    def _changes(self, entries: list[Entry]) -> DataFrame:
        tables = [self._read(e) for e in entries]
        if not tables:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("version", T.LongType())]))
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def history(self) -> DataFrame:
        """All changes, with the version of the log that made them."""
        return self._changes([e for e in self.entries() if not e.whole])

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The state of each key at a version of the log (the last one), with its revision; deleted keys are gone."""
        return self._current(version).filter(~F.col(DELETED)).drop(DELETED)

    def _current(self, version: int | None = None) -> DataFrame:
        entries = self.entries()
        if version is not None:
            if not 0 <= version <= len(entries):
                raise ValueError(f"{self.path} has no version {version}")
            entries = entries[:version]
        base = max((i for i, e in enumerate(entries) if e.whole), default=0)
        rows = self._changes(entries[base:])
        rest = F.struct(*[c for c in rows.columns if c not in self.key])
        last = rows.groupBy(*self.key).agg(F.max_by(rest, F.col(REVISION)).alias("__last"))
        return last.select(*[F.col(k) if k in self.key else F.col(f"__last.{k}").alias(k) for k in [*self.states, REVISION, DELETED]])

    # -- writing

    def commit(self, changes: DataFrame, *, expected: str = REVISION, writer: str | None = None, batch: int | None = None, attempts: int = 20) -> int:
        """Set the states of some keys; returns the version that holds the change.

        changes: a state's columns and `expected`, the revision that each was made from (null: the key has no
        state yet), and maybe `deleted`. If a key has another revision now, Conflict is raised and nothing
        changes. With a writer and a batch number, a batch that the writer has committed before is not written
        again.
        """
        if (done := self._batch(writer, batch)) is not None:
            return done
        flag = F.coalesce(F.col(DELETED), F.lit(False)) if DELETED in changes.columns else F.lit(False)
        rows = changes.select(*self.states, F.col(expected).cast("long").alias("__from"), flag.alias(DELETED))
        data = f"data/{uuid.uuid4().hex}"
        new = (F.coalesce(F.col("__from"), F.lit(0)) + 1).alias(REVISION)
        rows.select(*self.states, new, DELETED).write.parquet(f"{self.path}/{data}")
        # From here on the written rows are the change, however often `changes` would be worked out anew.
        written = self.spark.read.schema(self.schema).parquet(f"{self.path}/{data}")
        n, keys = written.count(), written.select(*self.key).distinct().count()
        if n != keys:
            self._drop(data)
            raise ValueError("a key is changed twice in one change")
        seen = self.version()
        self._check(written, self._current(seen), data)
        for _ in range(attempts):
            if self._put(Entry(seen + 1, data, n, writer, batch)):
                return seen + 1
            if (done := self._batch(writer, batch)) is not None:
                self._drop(data)
                return done
            others = self.entries()[seen:]
            self._check(written, self._changes([e for e in others if not e.whole]), data)
            seen += len(others)
        self._drop(data)
        raise Conflict(f"{self.path}: other writers were first {attempts} times")

    def _batch(self, writer: str | None, batch: int | None) -> int | None:
        if writer is None or batch is None:
            return None
        return next((e.version for e in self.entries() if e.writer == writer and e.batch == batch), None)

    def _check(self, written: DataFrame, current: DataFrame, data: str) -> None:
        """Refuse the change where a key's revision isn't the one it was made from."""
        now = current.groupBy(*[F.col(k).alias(f"__{k}") for k in self.key]).agg(F.max(REVISION).alias("__now"))
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.key]
        both = written.select(*self.key, (F.col(REVISION) - 1).alias("__from")).join(now, same, "left")
        # A change made from nothing against one that is made from the entries in between: those have some revision.
        wrong = both.filter(F.coalesce(F.col("__now"), F.col("__from") if self._partial(current) else F.lit(0)) != F.col("__from")).limit(1).collect()
        if wrong:
            self._drop(data)
            raise Conflict(f"{self.path}: {wrong[0].asDict()} was changed by another writer")

    @staticmethod
    def _partial(current: DataFrame) -> bool:
        """Whether a table holds the changes of some entries only (they carry their version)."""
        return "version" in current.columns

    def _drop(self, data: str) -> None:
        place, system = self._place(data)
        system.delete(place, True)

    def compact(self) -> int:
        """Write all states into one table, from which later snapshots start; returns its version."""
        while True:
            seen = self.version()
            data = f"data/{uuid.uuid4().hex}"
            self._current(seen).write.parquet(f"{self.path}/{data}")
            if self._put(Entry(seen + 1, data, self.spark.read.schema(self.schema).parquet(f"{self.path}/{data}").count(), whole=True)):
                return seen + 1
            self._drop(data)

    def collect_garbage(self) -> int:
        """Delete the tables that no entry names, left by writers that died; no writer may be at work. Returns how many."""
        folder, system = self._place("data")
        if not system.exists(folder):
            return 0
        named = {e.data.split("/")[1] for e in self.entries()}
        stray = [s.getPath() for s in system.listStatus(folder) if s.getPath().getName() not in named]
        for place in stray:
            system.delete(place, True)
        return len(stray)

    # -- use

    def update(self, rows: DataFrame, change: Callable[[DataFrame], DataFrame], *, writer: str | None = None, batch: int | None = None, attempts: int = 5) -> int:
        """Join rows (key columns and more) with their states, commit change(joined), and start again after a Conflict.

        change() gets all of rows' columns, the state's columns (null where there is none) and `revision`.
        """
        more = [c for c in rows.columns if c not in self.key]
        if set(more) & {*self.states, REVISION, DELETED}:
            raise ValueError("rows have columns of the state")
        for left in reversed(range(attempts)):
            now = self._current()
            renamed = now.select(*[F.col(k).alias(f"__{k}") for k in self.key], *[c for c in now.columns if c not in self.key and c != DELETED], F.col(DELETED).alias("__gone"))
            same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.key]
            both = rows.join(renamed, same, "left").drop(*[f"__{k}" for k in self.key])
            # A deleted state is told as none, but a new one goes on from its revision.
            alive = both.withColumns({c: F.when(~F.coalesce("__gone", F.lit(False)), F.col(c)) for c in self.states if c not in self.key}).drop("__gone")
            try:
                return self.commit(change(alive), writer=writer, batch=batch)
            except Conflict:
                if not left:
                    raise
        raise AssertionError("attempts must be positive")
