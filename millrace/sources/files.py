"""Checked reads and staged writes."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.series import sequence_gaps

# Fixed value: a key is a relative POSIX path of plain names.
KEY = r"^(?!.*(?:^|/)\.\.?(?:/|$))[A-Za-z0-9._-]+(?:/[A-Za-z0-9._-]+)*$"


def is_key(column: str):
    return F.col(column).rlike(KEY)


def bounded_files(spark: SparkSession, path: str, *, most_bytes: int, pattern: str = "*") -> DataFrame:
    """path, length, sha256, content of files; content and sha256 are null for files over the cap, which are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    small = F.col("length") <= most_bytes
    return files.select("path", "length", F.when(small, F.sha2("content", 256)).alias("sha256"), F.when(small, F.col("content")).alias("content"))


def exact_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table whose columns and types are those of the schema, in any order; another one is refused."""
    found = spark.read.parquet(path)
    kinds = lambda s: {f.name: f.dataType for f in s.fields}
    if kinds(found.schema) != kinds(schema):
        raise ValueError(f"{path}: columns differ from the schema")
    return found.select(*schema.fieldNames())


def strict_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines that must all fit the schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _digest_columns(df: DataFrame) -> list[Column]:
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("digest")]


def table_digest(df: DataFrame) -> DataFrame:
    """n and a digest that does not depend on the order of rows: hashes of rows, added up."""
    return df.agg(*_digest_columns(df))


#: The file that says what a published table holds; Spark does not read it as part of the table.
MARKER = "_published.json"


def publish(df: DataFrame, path: str) -> bool:
    """Write a table beside its place, read it back, compare, mark it with its digest and move it there at once.

    df is evaluated once: its digest is observed while it is written. True if it was published, False if the
    same table is there already; another table there is an error. Works on any file system that Spark can
    rename in.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, *_digest_columns(df)).write.parquet(staging)
    try:
        said = table_digest(spark.read.schema(df.schema).parquet(staging)).first()
        if said.asDict() != seen.get:
            raise RuntimeError("the table read back differs from the one written")
        if system.exists(target):
            if table_digest(spark.read.schema(df.schema).parquet(path)).first() != said:
                raise FileExistsError(f"{path} holds another table")
            return False
        marker = system.create(jvm.org.apache.hadoop.fs.Path(f"{staging}/{MARKER}"))
        marker.write(bytearray(json.dumps({"n": said["n"], "digest": said["digest"], "schema": df.schema.json()}).encode()))
        marker.close()
        if not system.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
            raise RuntimeError(f"cannot move the table to {path}")
        return True
    finally:
        system.delete(jvm.org.apache.hadoop.fs.Path(staging), True)


def open_published(spark: SparkSession, path: str) -> DataFrame:
    """A published table, once its rows have been found to be those that its marker names."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{MARKER}")
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(place):
        raise ValueError(f"{path} has no marker: it was not published")
    stream = system.open(place)
    try:
        said = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    found = spark.read.schema(T.StructType.fromJson(json.loads(said["schema"]))).parquet(path)
    if table_digest(found).first().asDict() != {"n": said["n"], "digest": said["digest"]}:
        raise ValueError(f"{path} does not hold what its marker names")
    return found


def schema_digest(schema: T.StructType) -> str:
    """A fingerprint of names, types, order and nullability, for comparing a table's form with the one agreed on."""
    return hashlib.sha256(json.dumps(schema.jsonValue(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def read_log(spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str], step: str, first: int = 1) -> DataFrame:
    """A log of JSON lines that all fit the schema and whose steps follow one another from `first` for each key; else refused."""
    rows = strict_json(spark, path, schema)
    wrong = sequence_gaps(rows, key, step, first).limit(1).collect()
    if wrong:
        raise ValueError(f"{path}: {wrong[0]['problem']} at {wrong[0].asDict()}")
    return rows


def append_batch(df: DataFrame, path: str, key: str, step: str) -> None:
    """Append the next records of a log: refused unless each key's steps follow its last one without a gap."""
    spark = df.sparkSession
    old = spark.read.schema(df.schema).parquet(path) if _exists(spark, path) else df.limit(0)
    last = old.groupBy(key).agg(F.max(step).alias("__last"))
    new = df.groupBy(key).agg(F.min(step).alias("__first"), F.max(step).alias("__end"), F.count_distinct(step).alias("__n"), F.count(F.lit(1)).alias("__rows")).join(last, key, "left")
    good = (F.col("__first") == F.coalesce("__last", F.lit(0)) + 1) & (F.col("__end") - F.col("__first") + 1 == F.col("__n")) & (F.col("__n") == F.col("__rows"))
    wrong = new.filter(~F.coalesce(good, F.lit(False))).select(F.col(key).cast("string")).limit(1).collect()
    if wrong:
        raise ValueError(f"the steps of {wrong[0][0]} do not follow one another")
    df.write.mode("append").parquet(path)


def rolled_back(spark: SparkSession, path: str, schema: T.StructType, step: str, last: int) -> DataFrame:
    """The records of a log up to a step: what a resumed run may go on from."""
    return spark.read.schema(schema).parquet(path).filter(F.col(step) <= last)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
