import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.llm.exact_dedup import deduplicate, duplicate_groups

ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "a "), (7, "x" * 200_000), (8, "x" * 200_000), (9, "x" * 199_999 + "y"), (3, "a"), (None, "b"), (None, "lone")]


def brute(rows, largest):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return {t: ((max if largest else min)((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_groups_against_brute_force(docs, keep, weak):
    hashing = {"content_hash": lambda t: F.length(t)} if weak else {}  # every length collides
    got = duplicate_groups(docs(ROWS), keep=keep, **hashing).collect()
    assert len(got) == len(ROWS)
    want = brute(ROWS, keep == "largest")
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    for r in got:
        assert by_digest[r.text_sha256] == (r.keep_id, r.group_size)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in kept}) == len(want)
    assert all(r.doc_id == r.keep_id for r in kept)


def test_deduplicate_keeps_one_row_of_each_text_with_all_columns(docs):
    table = docs(ROWS).withColumn("__h", F.lit(1)).withColumn("keep_id", F.lit("own"))
    kept = deduplicate(table, keep="largest")
    assert kept.columns == table.columns
    assert sorted((r.text or "", r.doc_id) for r in kept.collect()) == sorted((t, i) for t, (i, _) in brute(ROWS, True).items())


def test_empty_table(docs):
    assert duplicate_groups(docs([])).count() == 0
    assert deduplicate(docs([])).count() == 0


def test_no_python_in_the_plan(docs):
    plan = duplicate_groups(docs(ROWS))._jdf.queryExecution().toString() + deduplicate(docs(ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
