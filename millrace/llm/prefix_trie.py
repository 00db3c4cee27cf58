"""The trie of conversation prefixes, summed over subtrees by heavy-path decomposition.

1. Turns are numbered within their conversation by digests and lengths, texts stay behind. Reading a
   conversation in order, a task chains the digests: the key of a node is that of its parent and of its turn,
   128 bits of SHA-256. Only the running key is held.
2. Nodes are the distinct keys: counts and minima, combined before the shuffle, so a prefix that very many
   conversations share costs a few rows.
3. The child with most conversations is its parent's heavy child (of ties the one with the smallest
   conversation). A heavy path starts at the root or at a light child and follows heavy children to a leaf. A
   light child has at most half of its parent's conversations, so no branch has more than log2 of them.
4. What a path hands up is its own sum and that of the light paths below it: paths are attached to their
   parents round by round, from the paths with most light edges above them. At the end one suffix sum along
   each path, from its leaf upwards, gives every node the sum of its subtree.

Rounds grow with the logarithm of the conversations. Nothing is collected; sums along a path and digests of
long lists of ids run over sorted rows.

Defined results: a null role or text counts as empty, a null turn comes first; turns of one number follow each
other by role and then by the digest of their text. Rows with a null conversation id belong to none and are
left out. Repeated rows are turns of their own. A conversation without turns ends at the root; an empty table
gives no node. A text of any length is read whole. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import durable, forget, fresh_path, require, text_or_empty

KEY_BYTES = 16
ROOT = hashlib.sha256(b"").digest()[:KEY_BYTES]
#: Bytes of ids that are joined before they are hashed.
PIECE_BYTES = 1 << 20


def numbered_turns(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), turn_key, n_chars of each turn."""
    require(rows, conv_col, turn_col, role_col, text_col)
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    # The role's length keeps role and text apart.
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = rows.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        F.substring(F.unhex(said), 1, KEY_BYTES).alias("turn_key"),
        F.length(text).cast("long").alias("n_chars"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "turn_key")
    return turns.select("conv", F.row_number().over(order).alias("pos"), "turn_key", "n_chars")


def with_shared_heads(turns: DataFrame, *, group: int = 100, most: int = 5) -> DataFrame:
    """conv, pos, turn_key, n_chars: conversations that begin with the first turns of their group's first one.

    The first h turns of a conversation c are those of c - c % group, h = crc32(c) % (most + 1).
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)
    heads = turns.filter((F.col("pos") <= most) & (F.col("conv") % group == 0)).withColumnRenamed("conv", "base")
    known = turns.select("conv").distinct().withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % group)
    shared = known.filter("h > 0").join(heads, "base").filter("pos <= h").select("conv", "pos", "turn_key", "n_chars")
    own = turns.filter(F.col("pos") > h)
    # A row before the first turn stands for the conversation itself.
    start = turns.select("conv").distinct().select("conv", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("long").alias("n_chars"))
    return start.unionByName(shared).unionByName(own)


def conversations_as_they_are(turns: DataFrame) -> DataFrame:
    start = turns.select("conv").distinct().select("conv", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("long").alias("n_chars"))
    return start.unionByName(turns)


BRANCH = "conv bigint, depth bigint, key binary, parent binary, n_chars bigint, is_end boolean"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by conversation and place: the node that each turn leads to."""
    names = [c.split()[0] for c in BRANCH.split(", ")]
    conv, depth, key, waiting = None, 0, ROOT, None
    for batch in batches:
        out: list[tuple] = []
        for c, turn_key, n in zip(*(batch.column(x).to_pylist() for x in ("conv", "turn_key", "n_chars")), strict=True):
            if waiting is not None:
                out.append((*waiting, c != conv))
            if c != conv:
                conv, depth, key, parent = c, 0, ROOT, None
            else:
                parent, depth = key, depth + 1
                key = hashlib.sha256(parent + turn_key).digest()[:KEY_BYTES]
            waiting = (c, depth, key, parent, n)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) if i not in (2, 3) else pa.array(x, pa.binary()) for i, x in enumerate(zip(*out, strict=True))], names=names)
    if waiting is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) if i not in (2, 3) else pa.array([x], pa.binary()) for i, x in enumerate((*waiting, True))], names=names)


def branches(turns: DataFrame) -> DataFrame:
    """conv, depth, key, parent, n_chars, is_end: a row for each conversation and node on its way, as a written table."""
    ordered = turns.repartition("conv").sortWithinPartitions("conv", "pos")
    return durable(ordered.select("conv", "turn_key", "n_chars").mapInArrow(_chain, BRANCH), "branches")


def _list_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: SHA-256 of the ids of each key, in ascending order and comma-joined.

    ends: key, conv. Ids are dealt by ranges of (key, conv), so that a key with very many is joined by many tasks;
    one task then reads the pieces of a key one after the other, as bytes.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, None, [], 0
        for batch in batches:
            out = []
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist(), strict=True):
                if held and (k != key or size > PIECE_BYTES):
                    out.append((key, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    key, first = k, c
                held.append(str(c))
                size += len(held[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["key", "first", "ids"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([first]), pa.array([",".join(held)])], names=["key", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k == key:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    dealt = ends.select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    joined = dealt.mapInArrow(pieces, "key binary, first bigint, ids string")
    ordered = joined.repartition("key").sortWithinPartitions("key", "first")
    return ordered.select("key", "ids").mapInArrow(digests, "key binary, ends_sha256 string")


def nodes_of(steps: DataFrame) -> DataFrame:
    """key, parent, depth, conv_id, n_convs, n_chars, n_children, heavy (the heavy child's key), as a written table."""
    own = steps.groupBy("key").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_chars").alias("n_chars")
    )
    own = durable(own, "nodes")
    below = own.filter("parent is not null").groupBy(F.col("parent").alias("key"))
    children = below.agg(F.count(F.lit(1)).alias("n_children"), F.max_by("key", F.struct("n_convs", -F.col("conv_id"))).alias("heavy"))
    nodes = durable(own.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "nodes")
    forget(own)
    return nodes


def heavy_paths(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, path (its first node's key), level (light edges above it) of each node.

    Each node is read on the way of its smallest conversation, where the last light child before it begins its path.
    """
    up = nodes.select(F.col("heavy").alias("key"), F.lit(True).alias("is_heavy")).filter("key is not null")
    marks = nodes.select("key", "conv_id").join(up, "key", "left").select("key", "conv_id", F.col("is_heavy").isNull().alias("light"))
    way = steps.select("conv", "depth", "key").join(marks, "key")
    order = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    placed = way.select(
        "key",
        (F.col("conv") == F.col("conv_id")).alias("own"),
        F.last(F.when(F.col("light"), F.col("key")), ignorenulls=True).over(order).alias("path"),
        (F.sum(F.col("light").cast("int")).over(order) - 1).alias("level"),
    )
    return placed.filter("own").drop("own")


def subtree_sums(placed: DataFrame, sums: list[str]) -> DataFrame:
    """key and, for each column of `sums`, its sum over the node's subtree.

    placed: key, parent, depth, path, level and the columns, a written table.
    """
    spark = placed.sparkSession
    starts = placed.filter(F.col("key") == F.col("path")).select("path", "parent", "level")
    above = placed.select(F.col("key").alias("parent"), F.col("path").alias("above"))
    totals = placed.groupBy("path").agg(*[F.sum(c).alias(c) for c in sums])
    paths = durable(totals.join(starts, "path").join(above, "parent", "left").select("path", "parent", "above", "level", *sums), "paths")
    deepest = paths.agg(F.max("level")).first()[0]
    folder = fresh_path(spark, "path-sums")
    before, schema = None, paths.select("path", "parent", "above", *sums).schema
    for level in range(deepest if deepest is not None else -1, -1, -1):
        here = paths.filter(F.col("level") == level).select("path", "parent", "above", *sums)
        if before is not None:
            added = before.groupBy(F.col("above").alias("path")).agg(*[F.sum(c).alias(f"more_{c}") for c in sums])
            here = here.join(added, "path", "left").select("path", "parent", "above", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums])
        here.write.parquet(f"{folder}/level={level}")
        before = spark.read.schema(schema).parquet(f"{folder}/level={level}")
    if before is None:
        return placed.select("key", *sums)
    every = spark.read.schema(schema).parquet(*[f"{folder}/level={k}" for k in range(deepest + 1)])
    hung = every.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(*[F.sum(c).alias(f"more_{c}") for c in sums])
    held = placed.join(hung, "key", "left")
    upwards = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    return held.select("key", *[F.sum(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).over(upwards).alias(c) for c in sums])


def _narrow(value: str) -> Column:
    return F.col(value).cast("long").alias(value)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: as with_shared_heads() or conversations_as_they_are() gives them.
    """
    steps = branches(turns)
    nodes = nodes_of(steps)
    found = heavy_paths(steps, nodes)
    own = nodes.join(found, "key").select(
        "key",
        "parent",
        "depth",
        "path",
        "level",
        (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"),
    )
    sums = subtree_sums(durable(own, "placed"), ["n_leaves", "saved_tokens"])
    ends = _list_digests(steps.filter("is_end"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "key").join(ends, "key", "left").join(parents, "parent", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        *[_narrow(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def shared_prefix_trie(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """prefix_trie() of conversations that share the heads of their groups."""
    turns = durable(numbered_turns(rows, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col), "turns")
    return prefix_trie(with_shared_heads(turns))
