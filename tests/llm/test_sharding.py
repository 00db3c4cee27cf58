import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm.sharding import capacities, plan_of, ring_of, shard_rows

SIZES = {"virtual_nodes": 16, "ring_size": 512}


def walk(spots, ring, room, ring_size):
    """Row by row: (tick, order) -> shard, each row going clockwise from its tick to the first shard with room."""
    ticks, load, placed = sorted(ring), Counter(), []
    for spot in sorted(spots):
        start = next((k for k, t in enumerate(ticks) if t >= spot[0]), 0)
        for step in range(len(ticks)):
            shard = ring[ticks[(start + step) % len(ticks)]]
            if load[shard] < room[shard]:
                break
        placed.append((spot, shard, load[shard]))
        load[shard] += 1
    return placed


@pytest.mark.parametrize("rows", [0, 1, 5, 500])
def test_plan_is_the_row_by_row_walk(rows):
    ring = ring_of(5, 16, 512)
    spots = [((i * 7919 + i % 13) % 512, i) for i in range(rows)]
    room = capacities(rows, 5, 1.0)
    counts = Counter(t for t, _ in spots)
    plan = plan_of(counts, ring, room, 512)
    rank, got = Counter(), []
    for spot in sorted(spots):
        t = spot[0]
        part = next(p for p in plan if p[0] == t and p[1] <= rank[t] <= p[2])
        got.append((spot, part[3], part[4] + rank[t] - part[1]))
        rank[t] += 1
    assert got == walk(spots, ring, room, 512)


def test_counts_differ_by_one_and_slots_have_no_gaps(docs):
    rows = [(i, f"text {i}é" if i % 7 else None) for i in range(1003)] + [(4, "again"), (4, "again"), (None, "n"), (None, "n"), (None, None)]
    table = docs(rows).withColumn("tick", F.lit(1)).withColumn("size", F.lit(2)).withColumn("id", F.lit(3))
    got = shard_rows(table, 8, **SIZES).collect()
    assert len(got) == len(rows)
    by_shard = Counter(r.shard for r in got)
    assert set(by_shard) == set(range(8)) and max(by_shard.values()) - min(by_shard.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(by_shard[s]))
    texts = Counter((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((str(r.doc_id), r.size, r.text_crc32) for r in got) == texts


def test_one_id_and_copies_of_one_row_are_placed_whole(docs, monkeypatch):
    from millrace.llm import sharding

    monkeypatch.setattr(sharding, "PIECE", 50)
    rows = [(7, f"text {i}") for i in range(400)] + [(8, "same")] * 700 + [(i, "x" * 200_000 if i == 20 else "t") for i in range(10, 60)]
    got = shard_rows(docs(rows), 8, **SIZES).collect()
    by_shard = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(by_shard.values()) - min(by_shard.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(by_shard[s])) for s in range(8))
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32(t.encode())) for i, t in rows)


def test_even_loads_move_little_when_a_shard_is_added(docs):
    rows = [(i, "t") for i in range(4000)]
    place = {n: {r.doc_id: r.shard for r in shard_rows(docs(rows), n).collect()} for n in (8, 9)}
    assert sum(place[8][i] != place[9][i] for i in place[8]) < 0.2 * 4000


def test_looser_loads_move_little_when_a_shard_is_added(docs):
    rows = [(i, "t") for i in range(4000)]
    place = {n: {r.doc_id: r.shard for r in shard_rows(docs(rows), n, load_factor=1.25, virtual_nodes=128).collect()} for n in (8, 9)}
    moved = sum(place[8][i] != place[9][i] for i in place[8])
    assert max(Counter(place[9].values()).values()) <= 1.25 * 4000 / 9 + 1
    assert moved < 0.3 * 4000


def test_empty_table(docs):
    assert shard_rows(docs([]), 8).count() == 0
