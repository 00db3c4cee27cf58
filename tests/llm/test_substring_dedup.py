import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.substring_dedup import pack_gaps, remove_repeats, unpack_gaps


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute(rows, window):
    first = {}
    split = [(i, words_of(t)) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(seed, documents=60, vocabulary=5000):
    pick = random.Random(seed)
    fresh = lambda n: [f"w{pick.randrange(vocabulary)}" for _ in range(n)]
    passages = [fresh(pick.choice([24, 25, 49, 50, 51, 75, 120])) for _ in range(12)]
    rows = []
    for i in pick.sample(range(1000), documents):
        text = []
        for _ in range(pick.randint(1, 4)):
            text += fresh(pick.randint(0, 40)) + pick.choice(passages)
            if pick.random() < 0.3:
                cut = pick.choice(passages)
                text += cut[pick.randint(0, 20) :]
        rows.append((i, pick.choice([" ", "\n", "\t ", "  "]).join(text)))
    return rows


@pytest.mark.parametrize("window", [50, 7])
def test_against_brute_force(docs, window):
    rows = corpus(window) + [(2000, None), (2001, ""), (2002, " \n"), (2003, "é ü " * 40), (1999, "é ü " * 30)]
    got = remove_repeats(docs(rows), window=window)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute(rows, window)


def test_spans_and_text(docs):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(1, "a b " + shared + " c"), (2, "x y z " + shared + " end"), (3, shared)]
    got = {r.doc_id: r for r in remove_repeats(docs(rows)).collect()}
    assert got[1].spans is None and got[1].n_removed == 0
    assert [tuple(s) for s in got[2].spans] == [(3, 63)] and got[2].kept_text == "x y z end"
    assert got[3].kept_text == "" and got[3].n_removed == 60


def test_repeated_rows_null_ids_and_clashing_columns(docs):
    text = " ".join(f"s{i}" for i in range(60))
    rows = [(4, text), (4, text), (None, text), (7, text), (7, text), (4, "other " + text)]
    table = docs(rows).withColumn("id", F.lit(1)).withColumn("digest", F.lit("d")).withColumn("starts", F.lit(2))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in remove_repeats(table).collect())
    assert got == [("4", 60, 0), ("4", 60, 0), ("4", 61, 0), ("7", 60, 60), ("7", 60, 60), ("None", 60, 0)]


def test_empty_table(docs):
    assert remove_repeats(docs([])).count() == 0


def test_very_long_text(docs):
    long = " ".join(f"{i % 7919}q{i % 101}" for i in range(80_000))
    rows = [(1, long), (2, "new " + long)]
    assert sorted((r.doc_id, r.n_removed) for r in remove_repeats(docs(rows)).collect()) == [(1, 0), (2, 80_000)]


def test_gaps():
    for seed in range(20):
        pick = np.random.RandomState(seed)
        places = np.unique(pick.randint(0, 10 ** pick.randint(1, 6), 300))
        assert (unpack_gaps(pack_gaps(places)) == places).all()
    assert (unpack_gaps(pack_gaps(np.array([254, 255, 510, 766, 1276]))) == [254, 255, 510, 766, 1276]).all()


def thue_morse(n):
    """n letters of a sequence whose complement has the same value as a polynomial modulo 2**64, from 2048 on."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("letters", [2048, 65_536])
def test_words_of_one_pattern_are_told_apart(docs, letters):
    one, other = thue_morse(letters)
    rest = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join([one, *rest])), (2, " ".join([other, *rest])), (3, " ".join([one, *rest]))]
    assert sorted((r.doc_id, r.n_removed) for r in remove_repeats(docs(rows)).collect()) == [(1, 0), (2, 0), (3, 50)]
