"""The stages of the pipeline against brute force on a small corpus."""

import random
import re

import corpus_pipeline
import language_by_hand
import public_tokenizers
import pytest
import sentencepiece

from millrace.llm import decontaminate as d


def test_without_labels_texts_with_letters_stay(spark):
    rows = [(2, "the cat sat", None), (3, "日本語", None), (4, "12 + 7 = 19", None), (5, "", None), (6, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]


ITEMS = [(1, "Which of these four rivers flows through the old town of the northern province, and why is it so cold?"), (2, "Name three birds, please")]


def corpus():
    pick = random.Random(6)
    words = {"en": "the cat and dog house river runs over green hill with many small stones in water".split(), "de": "der hund und die katze haus fluss läuft über grünen hügel mit vielen kleinen steinen im wasser".split()}
    rows = []
    for i in range(0, 120, 2):
        lang = pick.choice(["en", "de"])
        rows.append((i, " ".join(pick.choices(words[lang], k=pick.randint(3, 60))), lang))
    long = max(rows, key=lambda r: len(r[1]))
    rows += [(201, rows[3][1], "en"), (203, rows[3][1], None), (205, long[1] + " stones", long[2]), (207, "the " + long[1], long[2])]
    rows += [(209, f"see the house: {ITEMS[0][1].upper()} and the dog", "en"), (211, "the river, name three birds please and the hill", "en")]
    rows += [(213, "1234 5678", "en"), (215, None, "en"), (217, "", "de"), (219, None, None), (213, "1234 5678", "en"), (221, "the cat \u2581 sat", "en"), (None, "the dog and the small cat in the green water", "en")]
    return rows


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def distance(segment, text):
    row = [0] * (len(text) + 1)
    for c in segment:
        new = [row[0] + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (c != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def by_hand(stage, rows):
    if stage == "language":
        said = language_by_hand.predictions([r[:3] for r in rows])
        return [r for r in rows if said[r[0]][0] != "und" and said[r[0]][1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    if stage == "exact copies":
        best = {}
        for r in rows:
            key = r[1] or ""
            if key not in best or (-1 if r[0] is None else r[0]) > (-1 if best[key][0] is None else best[key][0]):
                best[key] = r
        return list(best.values())
    if stage == "near copies":
        sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
        least = {i: i for i in sets}
        changed = True
        while changed:
            changed = False
            for a in sets:
                for b in sets:
                    if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and least[b] < least[a]:
                        least[a], changed = least[b], True
        return [r for r in rows if r[0] is None or least[r[0]] == r[0]]
    if stage == "benchmark passages":
        segments = [s for i, t in ITEMS for s in d.segments_of(i, t)]
        return [r for r in rows if not any(distance(s.chars.tolist(), d.normalise(r[1])[0].tolist()) <= s.edits for s in segments)]
    raise AssertionError(stage)


@pytest.fixture
def tables(spark, tmp_path):
    rows = [(*r, "src", len(r[1] or ""), k, "x") for k, r in enumerate(corpus())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key int, __gone string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def order(rows):
    return sorted(map(str, rows))


def test_each_stage_and_the_whole_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    sizes = [len(rows)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns
        rows = by_hand(name, rows)
        # Of repeated rows any may stay: the row's number in the fixture tells them apart.
        assert order((*r[:5], r[6]) for r in map(tuple, out.collect())) == order((*r[:5], r[6]) for r in rows), name
        sizes.append(len(rows))
        docs = spark.createDataFrame(rows, docs.schema)
    assert all(a > b for a, b in zip(sizes, sizes[1:], strict=False))  # each stage drops some
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.MODEL))
    got = corpus_pipeline.run(spark, tables).collect()
    assert order((r.doc_id, r.n_tokens) for r in got) == order((r[0], len(corpus_ids(library, r[1]))) for r in rows)
    assert all(r.round_trip for r in got)


def corpus_ids(library, text):
    """The library's ids; a literal space mark is spelled in three bytes."""
    from millrace.llm.sentencepiece_codec import Vocabulary, encode_text

    if "\u2581" in text:
        return encode_text(text, Vocabulary(open(public_tokenizers.path(corpus_pipeline.MODEL), "rb").read()).load())
    return library.encode(text)


def test_stages_on_an_empty_table_and_on_nulls(spark, tables):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_pred string, score double, ids int, matches int"
    nulls = [(None,) * 9, (1, None, None, None, None, None, None, None, None), (1, None, None, None, None, None, None, None, None)]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), tables).count() == 0
        out = stage(spark, spark.createDataFrame(nulls, schema), tables)
        want = {"language": 0, "exact copies": 1, "near copies": 3, "benchmark passages": 3, "token ids": 3}[name]
        assert out.count() == want, name
        assert name == "token ids" or out.columns == [c.split()[0] for c in schema.split(", ")]
