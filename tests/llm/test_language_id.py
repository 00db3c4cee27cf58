import zlib

import language_by_hand
import pytest
from pyspark.sql import functions as F

from millrace.llm.common import documents
from millrace.llm.language_id import Model, Scorer, held_out, identify, predict, train


def test_held_out_accuracy(spark, sf_dir):
    table = documents(spark, sf_dir)
    got = identify(table).join(table.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == table.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    apart = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in apart) >= 0.97 * len(apart)
    assert all(0 <= r.score <= 1 for r in got)


@pytest.fixture
def small(docs):
    return docs(
        [(i, "the cat and the dog", "en") for i in (0, 1, 3)]
        + [(i, "der hund und die katze", "de") for i in (5, 7, 8)]
        + [(11, "le chat", None), (12, None, "en"), (13, "", "de"), (14, "123 !?", "en"), (15, "漢字", "en"), (None, "the the", "en"), (16, "The dog and a cat. " * 15_000, "en"), (16, "The dog and a cat. " * 15_000, "en")]
    )


def test_defined_results(small):
    table = small.withColumn("word", F.lit(1)).withColumn("n", F.lit(2)).withColumn("__place", F.lit(3))
    got = [(str(r.doc_id), r.lang_pred) for r in identify(table).collect()]
    assert len(got) == small.count()
    said = dict(got)
    assert said["0"] == said["None"] == "en" and said["5"] == "de"
    assert said["12"] == said["13"] == said["14"] == "und"
    assert said["15"] in ("de", "en") and "fr" not in said.values()


def test_labels_ids_and_sources_are_not_read_in_prediction(small):
    model = train(small, ~held_out())
    changed = small.select((F.col("doc_id") + 100).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("other").alias("source"))
    said = lambda d: sorted((r.text or "", r.lang_pred, r.score) for r in predict(d, model).collect())
    assert said(small) == said(changed)


def test_words_come_first_and_grams_back_off():
    words = {("a", "zug"): 50, ("b", "zug"): 1, ("b", "other"): 60}
    grams = [{("a", "z"): 10, ("b", "z"): 10, ("b", "q"): 9, ("a", "q"): 1}, {("a", "zu"): 1, ("b", "zu"): 99, ("a", "xx"): 99}, {}, {}]
    model = Model.of_counts(["a", "b"], words, grams)
    score = Scorer(model)
    assert score("Zug zug")[0] == "a"  # the word says a, though its grams say b
    assert score("zur")[0] == "b"  # unseen: its 2-gram
    assert score("q")[0] == "b"  # unseen: its single character
    assert score("")[0] == score(None)[0] == score("12")[0] == "und"


def test_nothing_learned(docs):
    got = identify(docs([(2, "the cat", None), (3, "a", None)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2
    assert identify(docs([])).count() == 0


def test_bounded_sample(small):
    assert train(small, most_rows=4).languages  # some of the labelled rows


def test_the_whole_query_against_plain_python(spark, docs, sf_dir):
    rows = [(r.doc_id, r.text, r.lang) for r in documents(spark, sf_dir).collect()]
    rows += [(10_001, "e\u0301te\u0301 naïve", "fr"), (10_002, "𐐀𐐨x 12 𝔘y", "en"), (10_003, None, "en"), (10_004, "½ ² 12", "de"), (10_005, "zzzqqq xxwv", None), (10_006, "ß STRASSE ǅ", "de")]
    want = language_by_hand.predictions(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs(rows)).collect()}
    assert set(got) == set(want)
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in want)


def test_one_text_that_many_rows_hold_does_not_break_the_bound(spark, docs):
    from millrace.llm.language_id import _sample

    rows = docs([(7, "the same", "en")] * 500 + [(i, f"text {i}", "en") for i in range(1000)]).select("lang", "text")
    assert 50 <= _sample(rows, 100, 10**9).count() <= 180
    assert _sample(rows, 10**6, 10**9).count() == 1001
    assert _sample(rows, 10**6, 1000).count() <= 250
