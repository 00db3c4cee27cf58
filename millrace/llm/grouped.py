"""Cells of large groups, and reading sorted groups inside a task.

All members of a small group meet in one cell. A large one is cut into blocks, and its members first meet a
few pivots (star_cells): copies of the pivots go to every block, the members stay where they are. What hangs
together then need not meet again. Only the members outside the largest part that does meet all others
(rest_cells), block by block. So a group that hangs together costs a few copies of each member, and every
pair that may add a link still meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pivots of a large group, on average.
PIVOTS = 8
#: The part of a cell in which all pairs meet.
ALL_PAIRS = -1


def _cell(part: Column, left: bool, right: bool) -> Column:
    return F.struct(part.cast("long").alias("part"), F.lit(left).alias("left"), F.lit(right).alias("right"))


def _each(n: Column, f) -> Column:
    return F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: f(i))


def _dealt(rows: DataFrame, key: str, member: str, cells: Column) -> DataFrame:
    dealt = rows.withColumn("__cell", F.explode(cells)).select("*", "__cell.part", "__cell.left", "__cell.right").drop("__cell")
    return dealt.repartition(key, "part").sortWithinPartitions(key, "part", member)


def _block(member: str) -> Column:
    return F.pmod(F.xxhash64(F.col(member)), F.col("blocks"))


def star_cells(rows: DataFrame, key: str, member: str) -> DataFrame:
    """rows with part, left, right: in a cell (key, part) each left row meets each right one; with ALL_PAIRS all meet.

    rows has `members` and `blocks` of its group. A large group's cells are its blocks, which its pivots meet.
    """
    none = F.array().cast("array<struct<part:bigint,left:boolean,right:boolean>>")
    pivot = F.pmod(F.xxhash64(F.col(member), F.lit(1)), F.col("members")) < PIVOTS
    stars = F.concat(F.array(_cell(_block(member), False, True)), F.when(pivot, _each(F.col("blocks"), lambda b: _cell(b, True, False))).otherwise(none))
    return _dealt(rows, key, member, F.when(F.col("blocks") == 1, F.array(_cell(F.lit(ALL_PAIRS), True, True))).otherwise(stars))


def rest_cells(rows: DataFrame, key: str, member: str, ties: DataFrame) -> DataFrame:
    """The cells in which the members of large groups that are not tied to the rest meet all members.

    ties: key, pivot, node: the members that need not meet, because they hang together; a group without ties meets whole.
    """
    best = ties.select(F.col("key").alias(key), "pivot").distinct()
    tied = ties.select(F.col("key").alias(key), F.col("node").alias(member), F.lit(True).alias("__tied"))
    named = rows.filter("blocks > 1").join(best, key, "left").join(tied, [key, member], "left")
    free = F.col("__tied").isNull() & ~F.coalesce(F.col(member) == F.col("pivot"), F.lit(False))
    named = named.withColumn("__open", free).drop("pivot", "__tied")
    others = named.groupBy(key).agg(F.count_if("__open").alias("__others")).filter("__others > 0")
    open_rows = named.join(others, key).withColumn("__lefts", F.ceil(F.col("blocks") * F.col("__others") / F.col("members")))
    none = F.array().cast("array<struct<part:bigint,left:boolean,right:boolean>>")
    own, mine = _block(member), F.pmod(F.xxhash64(F.col(member), F.lit(2)), F.col("__lefts"))
    as_right = _each(F.col("__lefts"), lambda i: _cell(i * F.col("blocks") + own, False, True))
    as_left = F.when(F.col("__open"), _each(F.col("blocks"), lambda b: _cell(mine * F.col("blocks") + b, True, False))).otherwise(none)
    return _dealt(open_rows, key, member, F.concat(as_right, as_left)).drop("__open", "__others", "__lefts")


def _changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    change = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
    for k in keys:
        values = batch.column(k).to_numpy(zero_copy_only=False)
        change |= values[1:] != values[:-1]
    return change


def group_bounds(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where the groups of a sorted batch begin, and its end."""
    if not batch.num_rows:
        return np.zeros(1, dtype=np.int64)
    return np.concatenate(([0], np.flatnonzero(_changes(batch, keys)) + 1, [batch.num_rows]))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups from sorted batches whose borders may cut a group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            last = held[-1]
            same = all(last.column(k)[last.num_rows - 1].as_py() == batch.column(k)[0].as_py() for k in keys)
            if not same:
                yield _joined(held)
                held = []
        cut = np.flatnonzero(_changes(batch, keys))
        if len(cut):
            at = int(cut[-1]) + 1
            yield _joined([*held, batch.slice(0, at)])
            held = [batch.slice(at)]
        else:
            held.append(batch)
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    whole = pa.Table.from_batches(parts).combine_chunks().to_batches()
    if len(whole) > 1:
        raise ValueError("a group holds more than 2 GB in one column")
    return whole[0]
