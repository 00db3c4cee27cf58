import hashlib
import math
import random

import pytest

from millrace.llm import vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def by_hand(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    ids = sorted({i for i, _, _ in kept if i is not None})[:entries]
    first = {i: min(v for j, v, _ in kept if j == i) for i in ids}
    books = [[first[i][p * width : (p + 1) * width] for i in ids] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v, _ in kept:
                part = v[p * width : (p + 1) * width]
                own[nearest(part, books[p])[1]].append(part)
            books[p] = [[sum(c) // len(c) for c in zip(*o, strict=True)] if o else e for o, e in zip(own, books[p], strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out = []
    for i, v, lab in kept:
        found = [nearest(v[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
    of = {}
    for _, _, e, lab in out:
        of[lab] = of.get(lab, 0) + e
    return [(i, c, e, of[lab], digest) for i, c, e, lab in out]


def _told(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_equals_brute_force_with_nulls_ties_and_copies(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(32)], rng.choice([0, 1, None])) for i in range(120)]
    rows += [rows[5]] * 300 + [(7, rows[9][1], 4), (None, rows[2][1], 1)]
    rows += [(500, None, 1), (501, [None] * 32, 1), (502, [float("nan")] * 32, 1), (503, [float("inf")] + [0.0] * 31, 1)]
    table = spark.createDataFrame(rows, SCHEMA)
    exact = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    wide = table.selectExpr("*", "1 as row", "2 as id", "3 as ints", "4 as n")
    assert _told(vector_codes.code_report(wide)) == sorted(by_hand(exact), key=str)


def test_few_vectors_and_large_components(spark):
    rows = [(2, [3.0e6, -3.0e6] * 8, None), (1, [0.5] * 16, None), (3, [2.9e6, 1.0] * 8, 2)]
    assert _told(vector_codes.code_report(spark.createDataFrame(rows, SCHEMA))) == sorted(by_hand(rows), key=str)


def test_empty_table(spark):
    assert vector_codes.code_report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vector_codes.code_report(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []


def test_no_ids_at_all(spark):
    rows = [(None, [0.25 * i] * 16, 1) for i in range(3)]
    out = vector_codes.code_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r["error"] for r in out] == [0, 0, 0]


def test_unequal_lengths_are_refused(spark):
    with pytest.raises(ValueError):
        vector_codes.code_report(spark.createDataFrame([(1, [0.0] * 16, 1), (2, [0.0] * 32, 1)], SCHEMA))
    with pytest.raises(ValueError):
        vector_codes.code_report(spark.createDataFrame([(1, [0.0] * 15, 1)], SCHEMA))


def test_exact_where_every_part_is_an_entry(spark):
    rows = [(i, [float(i % 5)] * 16, 0) for i in range(40)]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), entries=64)
    back = vector_codes.decompress(coded, books).collect()
    assert all(r["ints"] == [256 * (r["id"] % 5)] * 16 and r["error"] == 0 for r in back)
