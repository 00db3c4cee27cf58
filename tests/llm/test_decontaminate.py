import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import decontaminate as d

LETTERS = "abcdefghijklmnopqrstuvwxyz     "


def prose(pick, n):
    return "".join(pick.choice(LETTERS) for _ in range(n))


def noisy(pick, text, rate):
    out = []
    for c in text:
        x = pick.random()
        if x < rate / 3:
            continue
        out.append(pick.choice("xyz") if x < rate else c)
        if rate * 2 / 3 < x < rate:
            out.append(pick.choice("abc"))
    return "".join(out)


def distance(segment, chars):
    """Edits between the segment and the part of chars most like it."""
    steps = np.arange(len(chars) + 1)
    row = np.zeros(len(chars) + 1, dtype=int)
    for c in segment:
        new = np.append(row[0] + 1, np.minimum(row[:-1] + (chars != c), row[1:] + 1))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def test_against_brute_force(spark, docs):
    pick = random.Random(5)
    items = [(i, prose(pick, pick.choice([30, 45, 80, 100, 130, 260]))) for i in range(12)] + [(50, None), (51, "")]
    rows = []
    for i in range(60):
        text, item = prose(pick, pick.randint(0, 600)), pick.choice(items[:12])[1]
        if i % 2:
            part = noisy(pick, item, pick.choice([0, 0.02, 0.05, 0.13]))
            text = text[:200] + " " + (part if i % 4 == 1 else part[: len(part) * 2 // 3]) + " " + text[200:]
        rows.append((i, text))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r.item_ids for r in d.contamination(docs(rows), benchmark).collect()}
    some = 0
    for i, text in rows:
        chars, _ = d.normalise(text)
        want = {item for item, t in items for s in d.segments_of(item, t) if distance(s.chars, chars) <= s.edits}
        assert got[i] == ",".join(map(str, sorted(want)))
        some += bool(want)
    assert 12 <= some < 60  # the fixture has both kinds


def test_spans_blocks_and_columns(spark, docs, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_CHARS", 60)
    items = [("a", "The quick brown fox jumps over the lazy dog near the river bank."), ("b", "Pack my box with five dozen liquor jugs, and do it before the night falls!"), ("a", "short")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    text = "Intro: THE QUICK, brown fox jumps over the lazy dog (near the river bank) -- then pack my box with five dozen liquor jugs and do it before the night falls. End"
    table = docs([(1, text), (2, "clean"), (3, None), (3, None), (4, ""), (None, text)]).withColumn("body", F.lit(1)).withColumn("item_id", F.lit(2))
    found = d.find_passages(table, benchmark)
    assert found.columns == [*table.columns, "matches"]
    got = {str(r.doc_id): r.matches for r in found.collect()}
    assert sorted(text[m.start : m.end] for m in got["1"]) == [
        "THE QUICK, brown fox jumps over the lazy dog (near the river bank",
        "pack my box with five dozen liquor jugs and do it before the night falls",
    ]
    assert sorted((m.item_id, m.distance) for m in got["None"]) == [("a", 0), ("b", 0)]
    kept = d.decontaminate(table, benchmark)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 3, 4]


def test_empty_tables_and_very_long_text(spark, docs):
    benchmark = spark.createDataFrame([(1, "one passage that is long enough to be looked for in every text")], "item_id bigint, text string")
    none = benchmark.limit(0)
    assert d.contamination(docs([]), benchmark).count() == 0
    assert [r.contaminated for r in d.contamination(docs([(1, "a")]), none).collect()] == [False]
    pick = random.Random(1)
    long = prose(pick, 400_000)
    got = d.contamination(docs([(1, long), (2, long + " one passage that is long enough to be looked for in every text")]), benchmark)
    assert {r.doc_id: r.contaminated for r in got.collect()} == {1: False, 2: True}


def test_short_items_and_signs_beyond_the_basic_plane(spark, docs):
    pick = random.Random(3)
    signs = "".join(chr(0x10400 + pick.randrange(40)) for _ in range(200))
    items = [(1, "What is the capital of France, now"), (2, signs), (3, "Yes!"), (4, "red apples"), (5, "it is?"), (6, "𝔘x 9")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [
        (1, "they asked: what is the capital of france now? nobody knew"),
        (2, f"a text that quotes {signs} whole"),
        (3, "yes"),
        (4, "yes and no"),
        (5, "some red apples fell"),
        (6, "some bored apples fell, and red appleseed"),
        (7, " It is."),
        (8, "so it is said"),
        (9, "((𝔘X-9))"),
        (10, signs[50:180]),
    ]
    got = {r.doc_id: r.item_ids for r in d.contamination(docs(rows), benchmark).collect()}
    assert got == {1: "1", 2: "2", 3: "3", 4: "", 5: "4", 6: "", 7: "5", 8: "", 9: "6", 10: "2"}


def test_a_verbatim_quote_of_a_segment_and_a_step_is_found_wherever_it_begins():
    pick = random.Random(9)
    item = prose(pick, 600)
    index = d.Index(d.segments_of(1, item))
    chars, places = d.normalise(item)
    clean = "".join(map(chr, chars))
    quote = d.SEGMENT + d.STEP - 1
    assert all(d.passages(f"zq {clean[at : at + quote]} qz", index) for at in range(0, len(clean) - quote, 7))


def test_a_text_that_repeats_itself_takes_linear_time_and_little_memory():
    import time
    import tracemalloc

    index = d.Index([s for k in range(3) for s in d.segments_of(k, "0" * 200)] + d.segments_of(9, "na " * 60))
    took = []
    for n in (30_000, 120_000):
        tracemalloc.start()
        began = time.time()
        found = d.passages("0" * n + " " + "na " * (n // 10), index)
        took.append(time.time() - began)
        assert tracemalloc.get_traced_memory()[1] < 100e6
        tracemalloc.stop()
        assert {f[0] for f in found} == {0, 1, 2, 9}
    assert took[1] < 8 * took[0] + 5


def test_frequent_grams_are_counted_in_slices(monkeypatch):
    pick = random.Random(4)
    index = d.Index([s for k in range(8) for s in d.segments_of(k, prose(pick, 150) + " ab" * 40)])
    text = prose(pick, 300) + " ab" * 300 + prose(pick, 3000)
    whole = d.passages(text, index)
    monkeypatch.setattr(d, "MOST_PAIRS", 500)
    assert whole and d.passages(text, index) == whole


def test_many_blocks_write_no_text(spark, docs, monkeypatch):
    pick = random.Random(6)
    items = [(i, prose(pick, 120)) for i in range(12)]
    rows = [(i, prose(pick, 80) + " " + items[i % 12][1] + " " + (items[(i + 5) % 12][1] if i % 3 else "") + prose(pick, 50)) for i in range(20)] + [(90, "clean text"), (91, None), (92, "")]
    rows += [rows[0], (None, rows[1][1])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    one = sorted((str(r.doc_id), r.item_ids, r.least_edits) for r in d.contamination(docs(rows), benchmark).collect())
    clean = sorted(str(r.doc_id) for r in d.decontaminate(docs(rows), benchmark).collect())
    written = []
    plain = d.durable
    monkeypatch.setattr(d, "durable", lambda df, label: (written.append(df.columns), plain(df, label))[1])
    monkeypatch.setattr(d, "BLOCK_CHARS", 150)
    assert sorted((str(r.doc_id), r.item_ids, r.least_edits) for r in d.contamination(docs(rows), benchmark).collect()) == one
    assert sorted(str(r.doc_id) for r in d.decontaminate(docs(rows), benchmark).collect()) == clean
    assert len(written) > 8 and not any({"text", "body"} & set(c) for c in written)
