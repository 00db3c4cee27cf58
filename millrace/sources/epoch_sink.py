"""Sinks of streams of events and metrics: each epoch is a folder that is there as a whole or not at all.

`sink.write` is the function of foreachBatch. An epoch is written beside its place, read back, and moved there
at once, so a failed one leaves nothing that a reader sees, and one that is sent again is written once. One
stream writes to a sink: its checkpoint numbers the epochs.

Defined results: an epoch of no rows is an epoch. Rows are kept as they are, repeated ones and nulls too. Columns
stand in the schema's order, whatever their order in a batch; a missing, further or differently typed one is refused.
A sink without epochs has no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What reading a sink adds to the columns of its rows.
EPOCH = "epoch"


class EpochSink:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        if EPOCH in schema.fieldNames():
            raise ValueError(f"{EPOCH} is the sink's own column")
        self.spark, self.path = spark, path.rstrip("/")
        # What a file holds may be null, whatever a schema says.
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])

    def _place(self, name: str = ""):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def epochs(self) -> list[int]:
        """Numbers of the epochs that are there."""
        folder, system = self._place()
        if not system.exists(folder):
            return []
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        return sorted(int(n[len(EPOCH) + 1 :]) for n in names if n.startswith(f"{EPOCH}="))

    def write(self, rows: DataFrame, epoch: int) -> bool:
        """Put an epoch in its place; False if it is there already."""
        kinds = lambda s: sorted((f.name, f.dataType.simpleString()) for f in s.fields)
        if kinds(rows.schema) != kinds(self.schema):
            raise ValueError(f"columns {rows.schema.simpleString()} are not {self.schema.simpleString()}")
        target, system = self._place(f"{EPOCH}={epoch}")
        if system.exists(target):
            return False
        folder, _ = self._place()
        system.mkdirs(folder)
        staging, _ = self._place(f".staging-{uuid.uuid4().hex}")
        try:
            seen = Observation()
            rows.select(*[F.col(f"`{c}`") for c in self.schema.fieldNames()]).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(staging.toString())
            held = self.spark.read.schema(self.schema).parquet(staging.toString()).count()
            if held != seen.get.get("n", 0):
                raise RuntimeError(f"epoch {epoch}: {held} rows read back")
            # A plain rename would move the folder into one that has come into its place meanwhile.
            if system.exists(target) or not system.rename(staging, target):
                raise RuntimeError(f"epoch {epoch} cannot be put in its place")
            return True
        finally:
            system.delete(staging, True)

    def read(self) -> DataFrame:
        """All rows with their epoch."""
        whole = T.StructType([*self.schema.fields, T.StructField(EPOCH, T.LongType())])
        if not self.epochs():
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", self.path).parquet(self.path)

    def roll_back(self, last: int) -> bool:
        """Drop the one epoch after `last`, which a checkpoint does not know. Further ones are refused: they were no accident."""
        later = [e for e in self.epochs() if e > last]
        if len(later) > 1:
            raise ValueError(f"{len(later)} epochs after {last}")
        for e in later:
            place, system = self._place(f"{EPOCH}={e}")
            system.delete(place, True)
        return bool(later)
