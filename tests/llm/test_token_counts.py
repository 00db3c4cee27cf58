import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from millrace.llm.common import fresh_path
from millrace.llm.token_counts import SentencePieceCounter, open_cache, token_counts, tokenizer_version

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = open(PATH, "rb").read()
ROWS = [(1, "Hello world"), (2, None), (3, ""), (4, "Hello world"), (4, "Hello world"), (5, "<s> </s> <unk> ▁ \n\t é🎉"), (None, "word " * 5000), (6, "x" * 100_000), (7, "Hello world ")]


def test_counts_are_those_of_the_library(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = token_counts(docs(ROWS).withColumn("content", F.lit(0)), fresh_path(spark, "cache"), SentencePieceCounter(MODEL), tokenizer_version(MODEL))
    want = sorted((str(i), len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in ROWS)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want


def recorder(path):
    """Counts characters and leaves a line for every text it is asked for."""

    def count(texts):
        with open(path, "a") as f:
            f.writelines(t[:20] + "\n" for t in texts)
        return [len(t) for t in texts]

    return count


def test_only_distinct_misses_are_encoded_and_versions_are_apart(spark, docs, tmp_path):
    cache, log = fresh_path(spark, "cache"), tmp_path / "asked"
    first = [(1, "aa"), (2, "bb"), (3, "aa"), (4, None)]
    assert sorted(r.n_tokens for r in token_counts(docs(first), cache, recorder(str(log)), "v1").collect()) == [0, 2, 2, 2]
    assert sorted(log.read_text().split("\n")) == ["", "", "aa", "bb"]
    log.unlink()
    again = token_counts(docs([*first, (5, "ccc")]), cache, recorder(str(log)), "v1")
    assert sorted(r.n_tokens for r in again.collect()) == [0, 2, 2, 2, 3]
    assert log.read_text() == "ccc\n"
    log.unlink()
    token_counts(docs([(1, "aa")]), cache, recorder(str(log)), "v2").collect()
    assert log.read_text() == "aa\n"
    assert open_cache(docs([]), cache).groupBy("tokenizer").count().orderBy("tokenizer").collect() == [("v1", 4), ("v2", 1)]


def test_empty_table(spark, docs):
    assert token_counts(docs([]), fresh_path(spark, "cache"), SentencePieceCounter(MODEL), "v").count() == 0
