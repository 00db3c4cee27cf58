import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from millrace.llm import sentencepiece_codec
from millrace.llm.sentencepiece_codec import MARK, Vocabulary, decode, decode_ids, encode, encode_and_verify, encode_text, stream

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()


@pytest.fixture(scope="module")
def v():
    return Vocabulary(MODEL).load()


@pytest.fixture(scope="module")
def u():
    """The same pieces and scores, read as those of a unigram model."""
    v = Vocabulary(MODEL).load()
    v.merges = False
    return v


def marked(text):
    return MARK + text.replace(" ", MARK)


def whole_lattice(chars, v):
    """The best segmentation over the whole lattice at once; chars: list of characters, literal marks as None."""
    best, back = [0.0], [None]
    for end in range(1, len(chars) + 1):
        top, choice = float("-inf"), None
        for start in range(max(0, end - v.longest), end):
            part = chars[start:end]
            found = None if None in part else v.score.get("".join(part))
            if found and best[start] + found[0] > top:
                top, choice = best[start] + found[0], (start, [found[1]])
        last = chars[end - 1]
        if (last is None or last not in v.score) and best[end - 1] + v.unknown > top:
            top, choice = best[end - 1] + v.unknown, (end - 1, [v.bytes[b] for b in (last or MARK).encode()])
        best.append(top)
        back.append(choice)
    ids, end = [], len(chars)
    while end:
        start, part = back[end]
        ids, end = part + ids, start
    return ids


def made_up(seed):
    pick = random.Random(seed)
    return "".join(pick.choice(["a", "be", "th", " ", "  ", MARK, "\n", "\t", "é", "日", "🎉", "ing", "Q", "1", "\x00", "<s>", "İ", ".", ",", "(", "'", "-", "_", "\"", "#"]) for _ in range(pick.randint(0, 90)))


def test_sums_of_scores_against_the_whole_lattice(u):
    for seed in range(250):
        text = made_up(seed)
        chars = [MARK, *(MARK if c == " " else None if c == MARK else c for c in text)] if text else []
        assert encode_text(text, u) == whole_lattice(chars, u)
        if MARK not in text and text:
            assert [i for r in stream(marked(text), u) for i in r] == whole_lattice(list(marked(text)), u)


def test_merges_against_merging_whole_texts(v):
    for seed in range(250):
        text = marked(made_up(seed).replace(MARK, ""))
        assert [i for r in stream(text, v) for i in r] == [i for part in v.merged(text) for i in ([v.score[part][1]] if part in v.score else [v.bytes[b] for b in part.encode()])]


LONG = ["word " * 2000, "x" * 5000, "the" * 2000, "日本語の文章" * 500, "aAbB" * 900, "\n" * 3000, " " * 5000, "ab1Q日z" * 700, "ing" * 1500]


def test_ids_are_given_out_within_a_short_window(v, u):
    for vocabulary in (v, u):
        for text in LONG if vocabulary is v else (LONG[0], "the" * 100):
            read, given, lag = 0, 0, 0

            def counted(text=text):
                nonlocal read
                for c in marked(text):
                    read += 1
                    yield c

            runs = []
            for run in stream(counted(), vocabulary):
                lag = max(lag, read - given)
                given += len(b"".join(vocabulary.said[i] for i in run).decode())
                runs += run
            assert given == read == len(text) + 1
            # Sums of scores may keep several phases of a repeated word open to the end.
            assert lag <= 2 * vocabulary.longest or vocabulary is u and text not in LONG[:1]
            assert vocabulary is u or runs == sentencepiece.SentencePieceProcessor(model_proto=MODEL).encode(text)


def test_every_chunk_goes_through_the_search(monkeypatch):
    fresh, seen = Vocabulary(MODEL).load(), []
    monkeypatch.setattr(sentencepiece_codec, "stream", lambda chars, v: seen.append(chars) or stream(chars, v))
    text = "Hello the world, the " + "y" * 100
    encode_text(text, fresh)
    assert set(seen) == set(fresh.chunk.findall(marked(text)))


def test_round_trip_and_the_library_reads_the_ids(v):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    for seed in range(250):
        text = made_up(seed)
        ids = encode_text(text, v)
        assert decode_ids(ids, v) == text
        assert library.decode(ids) == text


def test_tables(docs):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, " two  spaces "), (4, " two  spaces "), (None, "x" * 100_000), (5, "\n")]
    table = docs(rows).withColumn("said", F.lit(1))
    out = decode(encode(table, Vocabulary(MODEL)), Vocabulary(MODEL))
    assert out.columns == [*table.columns, "ids", "decoded"]
    assert all(r.decoded == r.text for r in out.collect())
    got = encode_and_verify(table, Vocabulary(MODEL)).collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids or []) for r in got)
    assert sum(r.ids is None for r in got) == 1
    assert encode_and_verify(docs([]), Vocabulary(MODEL)).count() == 0
    with pytest.raises(ValueError):
        encode(table.withColumn("ids", F.lit(1)), Vocabulary(MODEL))


def test_the_librarys_ids(spark, sf_dir, v):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    texts = [made_up(seed).replace(MARK, "") for seed in range(400)]
    texts += ["Hello The world", "x" * 3000, "the" * 700, "日本語の文章" * 40, "aAbB" * 50 + "\n" * 80, " " * 70, "▁".replace(MARK, " ")]
    assert all(encode_text(t, v) == library.encode(t) for t in texts)
    assert all([i for r in stream(marked(t), v) for i in r] == library.encode(t) for t in texts if t)
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("text IS NOT NULL")
    got = {r.doc_id: r for r in encode_and_verify(whole, Vocabulary(MODEL)).collect()}
    rows = [r for r in whole.collect() if MARK not in r.text]
    assert rows and all(got[r.doc_id].ids == library.encode(r.text) for r in rows)


def test_literal_marks_come_back_where_the_library_loses_them(v):
    for seed in range(250):
        text = made_up(seed)
        assert decode_ids(encode_text(text, v), v) == text

