"""From raw documents to token ids: language, exact and near copies, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. run() writes every
stage's rows as Parquet in the shared folder and reads them again for the next, so a lost executor costs
a stage at most.

Defined results of all stages: an empty table gives an empty result; a text of any length is read whole;
columns beyond doc_id, text and lang pass through every stage but the last unread, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, exact_dedup, language_id, near_dedup, sentencepiece_codec
from millrace.llm.common import documents, durable

#: A text goes if no language has this share of the evidence, or if it has no letter.
LEAST_LANGUAGE_SCORE = 0.4
NEAR_PERCENT = 85
MODEL = "piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows whose text is told to be in some language.

    Null and empty texts and texts without a letter go. A row with a null id or language is judged by its
    text like any other. Repeated rows are all kept or all go.
    """
    model = language_id.train(docs, ~language_id.held_out())
    if not model.languages:  # no row to learn from: no language can be told, so every text with a letter stays
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    lang, score = _free("lang", docs), _free("score", docs)
    said = language_id.predict(docs, model, pred_col=lang, score_col=score)
    return said.filter((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).drop(lang, score)


def _free(name: str, docs: DataFrame) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of equal texts the row with the largest id.

    Null counts as empty; a null id is less wanted than any other; of repeated rows one stays.
    """
    return exact_dedup.deduplicate(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group that similar texts tie together the row with the smallest id.

    Null and empty texts are similar to nothing and stay, as do rows with a null id; rows of one id stay or
    go together.
    """
    return near_dedup.deduplicate(docs, percent=NEAR_PERCENT)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows whose text holds a passage of the benchmark.

    Null and empty texts hold none and stay; repeated rows are all kept or all go; an empty benchmark drops
    nothing.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip: the text as ids, and whether they give it back.

    Null: null ids, 0 and true; empty: no ids; repeated rows give repeated results.
    """
    with open(public_tokenizers.path(MODEL), "rb") as f:
        vocabulary = sentencepiece_codec.Vocabulary(f.read())
    return sentencepiece_codec.encode_and_verify(docs, vocabulary)


STAGES = [
    ("language", language),
    ("exact copies", exact_copies),
    ("near copies", near_copies),
    ("benchmark passages", benchmark_passages),
    ("token ids", token_ids),
]

#: Learned language scores, banded alignment and merges by rank are not for SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
