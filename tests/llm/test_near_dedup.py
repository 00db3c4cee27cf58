import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import near_dedup
from millrace.llm.near_dedup import deduplicate, near_duplicates, shingles_of, signatures_of


def shingle_set(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {doc: (len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows)}


def corpus(seed, n):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(6):
        text = [pick.choice(words) for _ in range(pick.choice([3, 5, 60, 150]))]
        for _ in range(n):
            own = list(text)
            for _ in range(pick.randint(0, 4)):
                own[pick.randrange(len(own))] = pick.choice(words)
            rows.append(((" " if pick.random() < 0.5 else "\n").join(own)).upper() if pick.random() < 0.3 else " ".join(own))
    rows += [None, "", " \t\n", "lone", "É é", "é É"]
    ids = pick.sample(range(1, 10_000), len(rows))
    return list(zip(ids, rows, strict=True))


def as_dict(out):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}


def test_components_against_brute_force(docs):
    rows = corpus(1, 12)
    out = near_duplicates(docs(rows))
    assert as_dict(out) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_cells_of_large_groups_lose_no_link(docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rows = corpus(2, 25)
    assert as_dict(near_duplicates(docs(rows))) == brute(rows)


def test_a_large_group_costs_a_few_copies_and_every_open_pair_meets(spark):
    from millrace.llm.grouped import PIVOTS, rest_cells, star_cells

    n, blocks = 5000, 50
    rows = spark.range(n).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("rep"), F.lit(n).cast("long").alias("members"), F.lit(blocks).alias("blocks"))
    star = star_cells(rows, "key", "rep").collect()
    assert len(star) <= n + 4 * PIVOTS * blocks and sum(r.right for r in star) == n
    pivots = {r.rep for r in star if r.left}
    assert pivots and all({r.part for r in star if r.left and r.rep == p} == set(range(blocks)) for p in pivots)
    pivot = min(pivots)
    tied = lambda ids: ids.select(F.lit(1).cast("long").alias("key"), F.lit(pivot).cast("long").alias("pivot"), F.col("id").alias("node"))
    assert rest_cells(rows, "key", "rep", tied(spark.range(n).filter(f"id <> {pivot}"))).isEmpty()
    # Most of these are not tied to the rest: each of them meets each member.
    found = tied(spark.range(1000).filter(f"id >= 700 and id % 7 <> 3 and id <> {pivot}"))
    small, few = rows.filter("rep < 1000"), 10
    small = small.withColumn("members", F.lit(1000).cast("long")).withColumn("blocks", F.lit(few))
    cells = {}
    for r in rest_cells(small, "key", "rep", found).collect():
        cells.setdefault(r.part, ([], []))[r.right].append(r.rep)
    met = {(x, y) for left, right in cells.values() for x in left for y in right}
    outside = [i for i in range(1000) if (i < 700 or i % 7 == 3) and i != pivot]
    assert met == {(x, y) for x in outside for y in range(1000)}


def test_repeated_rows_null_ids_and_extra_columns(docs):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(5, text), (5, text), (None, text), (None, "only nameless"), (2, text + " more"), (9, None)]
    table = docs(rows).withColumn("key", F.lit(1)).withColumn("id", F.lit("x")).withColumn("class", F.lit(0))
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(table).collect())
    assert got == [("2", "2", True), ("5", "2", False), ("5", "2", False), ("9", "9", True), ("None", "2", False), ("None", "None", True)]
    kept = deduplicate(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [2, 9]


def test_empty_table(docs):
    assert near_duplicates(docs([])).count() == 0
    assert deduplicate(docs([])).count() == 0


def test_very_long_text(docs):
    text = " ".join(str(i % 977) + "x" + str(i) for i in range(60_000))
    rows = [(1, text), (2, text + " end"), (3, "short one")]
    assert as_dict(near_duplicates(docs(rows))) == {1: (59_996, 1), 2: (59_997, 1), 3: (1, 3)}


def test_estimate_is_corrected_for_chance():
    pick = random.Random(4)
    left, common, right = ([f"{k}{pick.random()}" for _ in range(3000)] for k in "abc")
    shingles, number = shingles_of(pa.array([" ".join(left + common), " ".join(common + right)]))
    _, bits = signatures_of(shingles, number)
    words = bits.view(np.uint64).reshape(2, -1)
    share = near_dedup._alike(words[0] ^ words[1]) / near_dedup.HASHES
    assert abs((share - 0.25) / 0.75 - 1 / 3) < 0.2
    assert 0.6 < near_dedup.least_estimate(0.85) < 0.7


def test_words_of_one_pattern_are_told_apart(docs):
    rows = []
    for k, n in enumerate((2048, 65_536)):
        word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
        rows += [(10 * k + 1, word), (10 * k + 2, word.translate(str.maketrans("ab", "ba"))), (10 * k + 3, word.upper())]
    assert as_dict(near_duplicates(docs(rows))) == {1: (1, 1), 2: (1, 2), 3: (1, 1), 11: (1, 11), 12: (1, 12), 13: (1, 11)}


def test_exact_shingles():
    from millrace.llm.wordhash import exact_shingles

    texts = ["A b c d e f", "a B c d e", "a b c d", "", "b c d e f a b c d e"]
    told, number = exact_shingles(texts, 5)
    assert number.tolist() == [2, 1, 1, 0, 6]
    of = np.split(told, np.cumsum(number)[:-1])
    assert of[0][0] == of[1][0] == of[4][5] and of[0][1] == of[4][0] and of[2][0] not in [*of[0], *of[1], *of[4]]


@pytest.mark.parametrize("few,block", [(64, 512), (0, 512), (0, 16), (10**6, 16)])
def test_families_at_the_threshold_against_brute_force(docs, monkeypatch, few, block):
    """Copies of one text that differ from it by so much that about half of all pairs are linked."""
    pick = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base, rows = [pick.choice(words) for _ in range(200)], []
    monkeypatch.setattr(near_dedup, "FEW_PAIRS", few)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    for i in range(90):
        own = list(base)
        for at in pick.sample(range(200), pick.choice([1, 2, 3, 4, 5, 8])):
            own[at] = f"x{i}-{at}"
        rows.append((i, " ".join(own)))
    assert as_dict(near_duplicates(docs(rows))) == brute(rows)


def test_a_chain_under_the_threshold_is_never_one_group(spark, docs, monkeypatch):
    """Texts of 100 words, each 12 words on from the last: 0.78 to the next, no link at all."""
    words = [f"w{i}" for i in range(12 * 600 + 100)]
    rows = [(i, " ".join(words[12 * i : 12 * i + 100])) for i in range(600)]
    cells, copies = [], []
    plain = near_dedup._confirmed

    def watched(dealt, percent):
        held = dealt.groupBy("key", "part").count().agg(F.max("count"), F.sum("count")).first()
        cells.append(held[0] or 0)
        copies.append(held[1] or 0)
        return plain(dealt, percent)

    monkeypatch.setattr(near_dedup, "_confirmed", watched)
    out = near_duplicates(docs(rows)).collect()
    assert all(r.kept for r in out)
    assert max(cells) <= 16 and sum(copies) <= 10 * len(rows)
