"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has `ring_size` ticks. Each shard owns `virtual_nodes` of them, placed by hash; a row belongs to
the tick of its id's hash, and its home is the first virtual node clockwise. Ticks are filled in ring
order: a home that is full passes the rest of a tick's rows on to the next virtual node whose shard has
room. Shards may take a fixed number of rows each, so the counts are as even as asked for whatever the
hash does, and adding a shard moves little besides what it takes.

Only counts by tick (ring_size numbers at most) come to the driver; the plan made of them, ranges of ranks
within ticks, has at most ring_size + virtual_nodes * shards rows and is broadcast. Rows that are alike in
id, checksum and size are counted before the shuffle and told again once they are placed, in pieces of
PIECE rows; the others of a tick are ranked in DEALS parts by hash, each with its own offset. So neither
rows with one id nor copies of one row gather in a task.

Law: `rows`. With load_factor 1 the counts of any two shards differ by one at most.

Defined results: a null text has size 1 and checksum 0. Rows with a null id are placed by their checksum.
Repeated rows are placed one by one, next to each other; a text of any length is one row. An empty table
gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import durable, require, text_or_empty

#: Parts of a tick that are ranked apart, and copies of a row that are told in one piece.
DEALS, PIECE = 64, 100_000
PLAN_SCHEMA = "tick int, first bigint, last bigint, shard int, base bigint"


def ring_of(shards: int, virtual_nodes: int, ring_size: int) -> dict[int, int]:
    """tick -> shard of the virtual nodes; where two fall on one tick, the later goes on to the next free one."""
    if shards * virtual_nodes > ring_size:
        raise ValueError("the ring has fewer ticks than virtual nodes")
    ring: dict[int, int] = {}
    for shard in range(shards):
        for k in range(virtual_nodes):
            tick = int.from_bytes(hashlib.sha256(f"{shard}/{k}".encode()).digest()[:8]) % ring_size
            while tick in ring:
                tick = (tick + 1) % ring_size
            ring[tick] = shard
    return ring


def capacities(total: int, shards: int, load_factor: float) -> list[int]:
    """Rows that each shard may take; together at least total."""
    if load_factor <= 1:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [math.ceil(load_factor * total / shards)] * shards


def plan_of(counts: dict[int, int], ring: dict[int, int], room: list[int], ring_size: int) -> list[tuple[int, int, int, int, int]]:
    """Ranges of ranks within ticks: (tick, first, last, shard, slot of the first)."""
    ticks = sorted(ring)
    left, used, plan = list(room), [0] * len(room), []
    at = 0
    for tick in sorted(counts):
        while at < len(ticks) and ticks[at] < tick:
            at += 1
        first, waiting, node = 0, counts[tick], at
        while waiting:
            shard = ring[ticks[node % len(ticks)]]
            take = min(waiting, left[shard])
            if take:
                plan.append((tick, first, first + take - 1, shard, used[shard]))
                left[shard] -= take
                used[shard] += take
                first += take
                waiting -= take
            node += 1
    return plan


def shard_rows(
    docs: DataFrame,
    shards: int,
    *,
    virtual_nodes: int = 128,
    ring_size: int = 1 << 14,
    load_factor: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    require(docs, id_col, text_col)
    body = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"))
    spot = F.when(F.col("id").isNotNull(), F.xxhash64("id")).otherwise(F.xxhash64("text_crc32", "size"))
    rows = rows.withColumn("spot", spot).withColumn("tick", F.pmod("spot", F.lit(ring_size)).cast("int"))
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(DEALS)).cast("int"))
    # The texts are read once: what is left of a row is a few numbers.
    alike = durable(rows.groupBy("tick", "deal", "spot", "id", "text_crc32", "size").agg(F.count(F.lit(1)).alias("n")), "alike")
    deals = alike.groupBy("tick", "deal").agg(F.sum("n").alias("held"))
    counts = {r["tick"]: r["n"] for r in deals.groupBy("tick").agg(F.sum("held").alias("n")).collect()}
    room = capacities(sum(counts.values()), shards, load_factor)
    plan = plan_of(counts, ring_of(shards, virtual_nodes, ring_size), room, ring_size)
    ranges = docs.sparkSession.createDataFrame(plan, PLAN_SCHEMA).withColumnRenamed("tick", "plan_tick")

    def before(n, *parts):
        return lambda *order: F.coalesce(F.sum(n).over(Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    offsets = deals.select("tick", "deal", before("held", "tick")("deal").alias("offset"))
    ranked = alike.withColumn("within", before("n", "tick", "deal")("spot", "id", "text_crc32", "size")).join(offsets, ["tick", "deal"])
    ranked = ranked.withColumn("from", F.col("offset") + F.col("within")).withColumn("to", F.col("offset") + F.col("within") + F.col("n") - 1)
    meets = (F.col("tick") == F.col("plan_tick")) & (F.col("from") <= F.col("last")) & (F.col("to") >= F.col("first"))
    placed = ranked.join(F.broadcast(ranges), meets).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        "shard",
        (F.col("base") + F.greatest("from", "first") - F.col("first")).alias("slot"),
        (F.least("to", "last") - F.greatest("from", "first") + 1).alias("n"),
    )
    pieces = placed.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))))
    pieces = pieces.repartition(id_col, "text_crc32", "piece")
    inside = F.explode(F.sequence(F.col("piece"), F.least(F.col("piece") + PIECE, F.col("n")) - 1))
    return pieces.withColumn("inside", inside).select(id_col, "size", "text_crc32", "shard", (F.col("slot") + F.col("inside")).cast("long").alias("slot"))
