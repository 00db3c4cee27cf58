"""Strict reading of JSON objects and of files that a manifest names."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Digits of an integer; the language itself reads no more than 4,300.
MOST_DIGITS = 1000


class _Refused(ValueError):
    pass


def _once(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise _Refused("repeated key")
    return found


def _number(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise _Refused("number is not finite")
    return value


def _constant(name: str) -> float:
    raise _Refused("number is not finite")


def _integer(text: str) -> int:
    if len(text) > MOST_DIGITS:
        raise _Refused("number is too long")
    return int(text)


def _size(value: object, depth: int, most_depth: int) -> int:
    if not isinstance(value, dict | list):
        return 0
    if depth > most_depth:
        raise _Refused("too deep")
    if isinstance(value, dict):
        return len(value) + sum(_size(v, depth + 1, most_depth) for v in value.values())
    return sum(_size(v, depth + 1, most_depth) for v in value)


def refusal(text: str | None, most_depth: int = 32, most_keys: int = 10_000, most_bytes: int = 1 << 20) -> str | None:
    """Why a text is not read as an object; None where it is."""
    if text is None:
        return "missing"
    if len(text.encode()) > most_bytes:
        return "too large"
    try:
        value = json.loads(text, object_pairs_hook=_once, parse_int=_integer, parse_float=_number, parse_constant=_constant)
        if not isinstance(value, dict):
            return "not an object"
        if _size(value, 1, most_depth) > most_keys:
            return "too many keys"
    except _Refused as error:
        return str(error)
    except (ValueError, RecursionError):  # JSONDecodeError is a ValueError
        return "not JSON"
    return None


def strict_objects(df: DataFrame, column: str, **caps: int) -> DataFrame:
    """df with refused: why the text of a column is not read, null where it is. Null texts are missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [refusal(t, **caps) for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], names=[*batch.schema.names, "refused"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("refused", T.StringType())]))


def bounded_parquet(spark: SparkSession, path: str, schema: T.StructType, *, most_rows: int, most_row_groups: int, most_bytes: int) -> DataFrame:
    """A table of exactly these columns whose files keep within caps, told by their footers before a row is read."""
    files = spark.read.parquet(path).inputFiles()
    names = spark.createDataFrame([(f,) for f in files], "file string")

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import unquote, urlparse

        for batch in batches:
            seen = []
            for file in batch.column("file").to_pylist():
                there = pq.ParquetFile(unquote(urlparse(file).path))
                size = sum(there.metadata.row_group(i).total_byte_size for i in range(there.metadata.num_row_groups))
                seen.append((there.metadata.num_rows, there.metadata.num_row_groups, size))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*seen, strict=True)] if seen else [pa.array([], pa.int64())] * 3, names=["rows", "groups", "bytes"])

    held = names.mapInArrow(footers, "rows bigint, groups bigint, bytes bigint").agg(*[F.sum(c).alias(c) for c in ("rows", "groups", "bytes")]).first()
    for name, most in (("rows", most_rows), ("groups", most_row_groups), ("bytes", most_bytes)):
        if (held[name] or 0) > most:
            raise ValueError(f"{held[name]} {name}, more than {most}")
    found = spark.read.parquet(path)
    if [(f.name, f.dataType) for f in found.schema] != [(f.name, f.dataType) for f in schema]:
        raise ValueError("columns differ")
    return found


def verified_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, status of each file of a manifest (path, size, sha256) or a folder (as bounded_files() reads it):
    good, missing, extra, unread (over the cap), wrong size or wrong digest. Empty files are not listed, so they are missing."""
    m = manifest.select("path", F.col("size").alias("__size"), F.col("sha256").alias("__sha"), F.lit(True).alias("__wanted"))
    f = files.select("path", "length", "sha256", F.lit(True).alias("__there"))
    status = (
        F.when(F.col("__there").isNull(), "missing")
        .when(F.col("__wanted").isNull(), "extra")
        .when(~F.col("length").eqNullSafe(F.col("__size")), "wrong size")
        .when(F.col("sha256").isNull(), "unread")
        .when(~F.col("sha256").eqNullSafe(F.col("__sha")), "wrong digest")
        .otherwise("good")
    )
    return m.join(f, "path", "full_outer").select("path", status.alias("status"))
