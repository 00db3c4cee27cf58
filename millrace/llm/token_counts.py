"""Token counts through a digest cache.

A text is known by the digest of its normalised content, a tokenizer by the digest of its model. Texts
whose (content, tokenizer) pair is in the cache take the stored count; of the others each distinct text
is encoded once and its count appended to the cache, a Parquet table that later runs and other jobs
share; it is laid out by tokenizer, so a run reads the entries of its own only. Counts are read back from
the cache, so a task that is run again finds or makes the same rows.

The normalisation must not change a count: by default it only reads null as the empty text.

Defined results: null and empty texts count what the tokenizer gives for "" (0); repeated rows and
repeated texts keep a row each; a text of any length is encoded whole; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import require, text_or_empty, text_slices

CACHE_SCHEMA = T.StructType(
    [
        T.StructField("content", T.BinaryType()),
        T.StructField("tokenizer", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)


def _same(text: Column) -> Column:
    return text


def tokenizer_version(model: bytes) -> str:
    return hashlib.sha256(model).hexdigest()


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class SentencePieceCounter:
    """Counts tokens of a batch of texts as the sentencepiece library does by default; loads its model once a worker."""

    def __init__(self, model: bytes):
        self.model = model
        self._processor = None

    def __getstate__(self):
        return {"model": self.model, "_processor": None}

    def __call__(self, texts: list[str]) -> list[int]:
        if self._processor is None:
            import sentencepiece

            self._processor = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        return [len(ids) for ids in self._processor.encode(texts, num_threads=1)]


def open_cache(docs: DataFrame, cache_path: str) -> DataFrame:
    """The cache table; an empty one is made where there is none."""
    spark = docs.sparkSession
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").partitionBy("tokenizer").parquet(cache_path)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def _known(cache: DataFrame, version: str) -> DataFrame:
    # Two jobs may have appended the same text: one row stays.
    return cache.filter(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(
    docs: DataFrame,
    cache_path: str,
    count: Callable[[list[str]], list[int]],
    version: str,
    *,
    text_col: str = "text",
    normalise: Callable[[Column], Column] = _same,
) -> None:
    """Encode each distinct text of docs that the cache does not hold, and append the counts."""
    require(docs, text_col)
    known = _known(open_cache(docs, cache_path), version)
    body = normalise(text_or_empty(text_col))
    texts = docs.select(body.alias("body")).withColumn("content", content_digest(F.col("body")))
    # Copies collapse before the shuffle; of equal digests any one text will do.
    misses = texts.groupBy("content").agg(F.first("body").alias("body")).join(known, "content", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "body"):
                counts = count(part.column("body").to_pylist())
                columns = [part.column("content"), pa.array([version] * len(counts)), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["content", "tokenizer", "n_tokens"])

    misses.select("content", "body").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache_path)


def token_counts(
    docs: DataFrame,
    cache_path: str,
    count: Callable[[list[str]], list[int]],
    version: str,
    *,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = _same,
) -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8, of the text as it is), n_tokens, over_limit."""
    require(docs, id_col, text_col)
    fill_cache(docs, cache_path, count, version, text_col=text_col, normalise=normalise)
    known = _known(open_cache(docs, cache_path), version)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.octet_length(text_or_empty(text_col)).cast("long").alias("n_bytes"),
        content_digest(normalise(text_or_empty(text_col))).alias("content"),
    )
    counted = rows.join(known, "content", "left")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
