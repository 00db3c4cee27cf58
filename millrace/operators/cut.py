"""Cutting the lineage of a long job with a reliable checkpoint, and tables into parts of bounded rows."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Rows of a part, about.
PART_ROWS = 500_000


def parts_for(rows: int, each: int = PART_ROWS) -> int:
    """How many parts hold `each` rows at most, about: the number grows with the rows, a task's memory doesn't."""
    return max(1, -(-rows // max(1, each)))


def dealt(df: DataFrame, keys: Sequence[str], each: int = PART_ROWS) -> DataFrame:
    """df, which is counted, dealt by a hash of keys into parts of `each` rows at most, about."""
    return df.repartition(parts_for(df.count(), each), *keys)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder, which all executors share, and read from there.

    Where none is set, a local session gets one of its own; on a cluster it would lie on one machine.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, for tables of one's own; where it is unset, as in checkpointed()."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")
