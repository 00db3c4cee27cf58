"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import base64
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    decontaminate,
    exact_dedup,
    language_id,
    license_scan,
    near_dedup,
    oracles,
    pii,
    prefix_trie,
    secret_scan,
    sentencepiece_codec,
    sharding,
    substring_dedup,
    token_counts,
    vector_codes,
)
from millrace.llm.common import documents, fresh_path


def _bytes_of(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = sentencepiece_codec.Vocabulary(_bytes_of("piece_bpe_32k.model"))
    return sentencepiece_codec.encode_and_verify(documents(spark, sf_dir), vocabulary)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _bytes_of("byte_bpe_50k.tiktoken").splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}
    efficiency = secret_scan.TokenEfficiency(ranks, public_tokenizers.PATTERN)
    return secret_scan.report(secret_scan.find_secrets(documents(spark, sf_dir), efficiency))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(documents(spark, sf_dir), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir), license_scan.known_licenses(spark))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, sf_dir), keep="largest")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), percent=85)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir), window=50, with_text=False)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own each time: the query shows the cost of texts that no cache holds yet."""
    model = _bytes_of("piece_bpe_32k.model")
    counter, version = token_counts.SentencePieceCounter(model), token_counts.tokenizer_version(model)
    return token_counts.token_counts(documents(spark, sf_dir), fresh_path(spark, "token-cache"), counter, version, limit=4096)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_personal_data(documents(spark, sf_dir)))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_secret_scan": op2_secret_scan,
    "op3_sharding": op3_sharding,
    "op4_license_scan": op4_license_scan,
    "op5_language_id": op5_language_id,
    "op6_decontamination": op6_decontamination,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_personal_data": op12_personal_data,
    "op13_vector_codes": op13_vector_codes,
}

SQL: dict[str, str] = {
    "op4_license_scan": f"""
        WITH known AS (
            SELECT form, min(license) AS license
            FROM (SELECT license, {license_scan.canonical_sql("text")} AS form FROM (VALUES {license_scan.known_sql()}) AS k(license, text)) GROUP BY form
        ), lines AS (
            SELECT doc_id, {license_scan.canonical_sql("line")} AS form
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
        ), noted AS (
            SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names
            FROM lines JOIN known USING (form) GROUP BY doc_id
        )
        SELECT d.doc_id, k.license, coalesce(n.names, '') AS line_licenses, coalesce(n.n, 0) AS n_license_lines
        FROM (SELECT doc_id, {license_scan.canonical_sql("coalesce(text, '')")} AS form FROM documents) d
        LEFT JOIN known k ON k.form = d.form AND d.form <> '' LEFT JOIN noted n ON n.doc_id = d.doc_id
    """,
    "op7_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
    "op8_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                             '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
                                           WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
            FROM words
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), pairs AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
            FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
            WHERE 100 * common >= 85 * (p.n + q.n - common)
        ), reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
        ), least AS (
            SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
        FROM documents d JOIN least l ON l.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
    """,
    "op9_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)
        ), later AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM windows) WHERE doc_id > least
        ), gone AS (
            SELECT doc_id, list(DISTINCT place) AS places FROM (SELECT doc_id, unnest(range(i, i + 50)) AS place FROM later) GROUP BY doc_id
        )
        SELECT words.doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed,
               sha256(array_to_string(CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
        FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id
    """,
    "op11_prefix_trie": oracles.prefix_trie(),
    "op12_personal_data": oracles.personal_data(),
    "op13_vector_codes": oracles.vector_codes(),
}
