"""Near-duplicate detection with b-bit MinHash.

1. Each text gets 128 minima of its set of 5-word shingles. Five minima make a band key, 25 bands in
   all; of every minimum only the low two bits are kept, packed into 32 bytes.
2. Texts with the same word sequence are one class; its smallest id stands for it.
3. Classes that share a band key are candidates. Their packed signatures are compared by bit counts and
   the share of equal values is corrected for chance matches; pairs whose estimate lies far below the
   threshold go. A bucket larger than a block is dealt over cells (grouped.py).
4. What looks similar is confirmed on the full sets, word by word. First each class meets one other, the
   smallest similar one of its buckets, so that a family meets the same few and most of it is tied. What
   looks similar and isn't tied then hangs together in groups: one with few such pairs for its size (a chain
   of texts just under the threshold) meets as pairs, a few copies of each text; in a dense one all open
   members meet, block by block.
5. Components of the confirmed links.

A link of similarity s is missed by all bands with probability (1 - s**5)**25: 4e-7 at 0.85, less above.
The estimate's margin is five standard deviations. Nothing is capped: every pair of a bucket that could
join two parts is compared. A large family whose members lie just under the threshold of each other costs
all its pairs.

Defined results: null and empty texts, and texts of separators only, have no shingles, are linked with
nothing and stay. Repeated rows of one id share their result. A row with a null id takes the component of
its class (null if no other row of the class has an id); it stays only in the latter case. A text of any
length is read whole. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import durable, forget, require, text_or_empty, text_slices
from millrace.llm.components import components
from millrace.llm.grouped import ALL_PAIRS, group_bounds, rest_cells, star_cells, whole_groups
from millrace.llm.wordhash import exact_shingles, mix, ranges, spans_hash, words_of

SHINGLE = 5
HASHES, ROWS, BANDS, BITS = 128, 5, 25, 2
#: Members of a block: a cell compares two blocks at most.
BLOCK = 512
#: Bytes of text in a cell whose full sets are compared.
CELL_BYTES = 4 << 20
#: Pairs a member, counted once for each bucket, up to which a group's open pairs meet as pairs.
FEW_PAIRS = 64

_seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTOR, OFFSET = _seeds[:HASHES] | np.uint64(1), _seeds[HASHES:]


def least_estimate(threshold: float) -> float:
    """Estimates below this are five standard deviations under the threshold."""
    chance = 0.5**BITS
    match = threshold + (1 - threshold) * chance
    return threshold - 5 * (match * (1 - match) / HASHES) ** 0.5 / (1 - chance)


def shingles_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle fingerprints of each text, in order and with repeats, and how many each text has."""
    words = words_of(column, lower=True)
    counts, first = words.counts, words.first[:-1]
    number = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    start = ranges(first, number)
    last = np.repeat(first + counts, number)
    return spans_hash(words, start, np.minimum(start + SHINGLE, last)), number


def signatures_of(shingles: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts, BANDS) and packed low bits (texts, 32) of the texts that have shingles."""
    begin = np.concatenate(([0], np.cumsum(number)[:-1]))[number > 0]
    minima = np.empty((len(begin), HASHES), dtype=np.uint64)
    for i in range(HASHES):
        minima[:, i] = np.minimum.reduceat(shingles * FACTOR[i] + OFFSET[i], begin) if len(begin) else 0
    keys = np.empty((len(begin), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(begin), band + 1, dtype=np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key * np.uint64(0xD1342543DE82EF95) + minima[:, i])
        keys[:, band] = key
    low = (mix(minima) & np.uint64(3)).astype(np.uint8)
    bits = np.stack([low >> 1, low & 1], axis=2).reshape(len(begin), HASHES * BITS)
    return keys, np.packbits(bits, axis=1)


def class_digests(column: pa.Array) -> list[bytes]:
    """128 bits of the lower-cased word sequence: texts with the same one have the same set."""
    return [hashlib.md5(b" ".join((t or "").encode().lower().split())).digest() for t in column.to_pylist()]


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, class, bands (empty without shingles), bits."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    id_type = rows.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "body"):
                body = part.column("body")
                shingles, number = shingles_of(body)
                stop = np.cumsum(number)
                distinct = [len(np.unique(shingles[e - n : e])) for n, e in zip(number.tolist(), stop.tolist(), strict=True)]
                keys, bits = signatures_of(shingles, number)
                some = (number > 0).astype(np.int32)
                at = np.concatenate(([0], np.cumsum(some))).astype(np.int32)
                bands = pa.ListArray.from_arrays(at * BANDS, pa.array(keys.view(np.int64).ravel()))
                packed = [bits[at[i]].tobytes() if some[i] else b"" for i in range(len(some))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(distinct, pa.int64()), pa.array(class_digests(body), pa.binary()), bands, pa.array(packed, pa.binary())],
                    names=["id", "n_shingles", "class", "bands", "bits"],
                )

    return rows.mapInArrow(sign, f"id {id_type}, n_shingles bigint, class binary, bands array<bigint>, bits binary")


def _alike(bits: np.ndarray) -> np.ndarray:
    """Of XORed signatures (…, 4 words): the number of values that agree in both bits."""
    differ = (bits | (bits >> np.uint64(1))) & np.uint64(0x5555555555555555)
    return HASHES - np.bitwise_count(differ).sum(axis=-1, dtype=np.int64)


CELL = ["key", "part"]


def _merged(tree: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """One of `others` from each tree that i does not belong to yet; `tree` is changed so that it does."""
    found, at = np.unique(tree[others], return_index=True)
    new = found != tree[i]
    if not new.any():
        return others[:0]
    tree[np.isin(tree, found)] = tree[i]
    return others[at[new]]


def _similar_pairs(dealt: DataFrame, threshold: float, how: str) -> DataFrame:
    """leaf, hub, n: pairs of a cell that look similar by their bits and that no link ties yet.

    dealt: key, part, left, right, rep, label, tried, n_shingles, bits. how: "first", each row with the first similar
    one of its cell; "all"; "forest", pairs enough to connect what is similar, and each row with itself and the
    number of its pairs.
    """
    least, chance = least_estimate(threshold), 0.5**BITS

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches, CELL):
            rep, label, tried, size, part = (chunk.column(c).to_numpy() for c in ("rep", "label", "tried", "n_shingles", "part"))
            is_left, is_right = (chunk.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
            bits = np.frombuffer(b"".join(chunk.column("bits").to_pylist()), dtype=np.uint64).reshape(-1, HASHES * BITS // 64)
            leaf, hub, count = [], [], []

            def similar(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                share = _alike(bits[i] ^ bits[j]) / HASHES  # noqa: B023
                fits = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9  # noqa: B023
                fits &= ((share - chance) / (1 - chance) >= least) & (label[i] != label[j])  # noqa: B023
                return fits & (tried[i] != rep[j]) & (tried[j] != rep[i])  # noqa: B023

            def keep(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> None:
                for at, values in zip((leaf, hub, count), (rep[i], rep[j], n), strict=True):  # noqa: B023
                    at.append(values)

            bounds = group_bounds(chunk, CELL)
            sizes, every = np.diff(bounds), part[bounds[:-1]] == ALL_PAIRS if len(part) else np.zeros(0, dtype=bool)
            for n in range(2, 5):  # the many small buckets: all of one size at once
                begin = bounds[:-1][(sizes == n) & every]
                for x in range(n):
                    for y in range(x + 1, n):
                        at = begin[similar(begin + x, begin + y)]
                        keep(at + y, at + x, np.zeros(len(at), dtype=np.int64))
                        if how == "forest":
                            keep(at + y, at + y, np.ones(len(at), dtype=np.int64))
            for k in np.flatnonzero((sizes >= 5) | ~every).tolist():
                begin, end = int(bounds[k]), int(bounds[k + 1])
                if every[k] and (label[begin:end] == label[begin]).all():
                    continue
                right, tree = begin + np.flatnonzero(is_right[begin:end]), np.arange(end - begin)
                free, pairs = np.ones(end - begin, dtype=bool), np.zeros(end - begin, dtype=np.int64)
                for i in (begin + np.flatnonzero(is_left[begin:end])).tolist():
                    others = right[right > i] if every[k] else right
                    others = others[similar(np.full(len(others), i), others)]
                    if how == "first":
                        others = others[free[others - begin]]
                        free[others - begin] = False
                    elif how == "forest":
                        pairs[i - begin] = len(others)
                        others = begin + _merged(tree, i - begin, others - begin)
                    keep(others, np.full(len(others), i), np.zeros(len(others), dtype=np.int64))
                if pairs.any():
                    some = np.flatnonzero(pairs)
                    keep(begin + some, begin + some, pairs[some])
            columns = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (leaf, hub, count)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["leaf", "hub", "n"])

    return dealt.select("key", "part", "left", "right", "rep", "label", "tried", "n_shingles", "bits").mapInArrow(compare, "leaf bigint, hub bigint, n bigint")


def crowded_buckets(classes: DataFrame) -> DataFrame:
    """key, rep, n_shingles, bits, members, blocks of the classes that share a band key, as a written table."""
    rows = classes.select("rep", "n_shingles", "bits", F.explode("bands").alias("key"))
    shared = classes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return durable(rows.join(shared, "key").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")), "crowded")


def _rest(rows: DataFrame, member: str, some_large: bool) -> DataFrame:
    """The cells in which the members of each group meet: of a large one, those without its commonest label meet all."""
    if not some_large:
        every = rows.withColumns({"part": F.lit(ALL_PAIRS).cast("long"), "left": F.lit(True), "right": F.lit(True)})
        return every.repartition("key").sortWithinPartitions("key", member)
    large = rows.filter("blocks > 1")
    counts = large.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    common = counts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("pivot"))
    ties = large.join(common, "key").filter("label = pivot").select("key", "pivot", F.col(member).alias("node"))
    small = rows.filter("blocks = 1").withColumns({"part": F.lit(ALL_PAIRS).cast("long"), "left": F.lit(True), "right": F.lit(True)})
    # Each kind of cell lies in partitions of its own, sorted.
    return small.repartition("key").sortWithinPartitions("key", member).unionByName(rest_cells(rows, "key", member, ties))


def _confirmed(dealt: DataFrame, percent: int) -> DataFrame:
    """a, b: links enough to connect the nodes of each cell whose sets of word sequences are similar enough.

    dealt: key, part, left, right, node, label, body. Nodes of one label hang together already. Sequences are
    compared by their words.
    """

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches, CELL):
            node, label, part = (chunk.column(c).to_numpy() for c in ("node", "label", "part"))
            is_left, is_right = (chunk.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
            bounds, a, b = group_bounds(chunk, CELL), [], []
            for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                n, own = end - begin, slice(begin, end)
                shingles, number = exact_shingles(chunk.column("body").slice(begin, n).to_pylist(), SHINGLE)
                room = int(shingles.max(initial=0)) + 1
                of, shingles = np.divmod(np.unique(np.repeat(np.arange(n), number) * room + shingles), room)
                size, stop = np.bincount(of, minlength=n), np.searchsorted(of, np.arange(n), side="right")
                mark, tree = np.zeros(room, dtype=bool), np.unique(node[own], return_inverse=True)[1]
                for i in np.flatnonzero(is_left[own]).tolist():
                    mine = shingles[stop[i] - size[i] : stop[i]]
                    mark[mine] = True
                    common = np.bincount(of[mark[shingles]], minlength=n)
                    mark[mine] = False
                    linked = is_right[own] & (label[own] != label[begin + i]) & (common > 0) & (100 * common >= percent * (size + size[i] - common))
                    if part[begin] == ALL_PAIRS:
                        linked[: i + 1] = False
                    others = _merged(tree, i, np.flatnonzero(linked))
                    a.append(np.full(len(others), node[begin + i]))
                    b.append(node[begin + others])
            columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b"])

    return dealt.select("key", "part", "left", "right", "node", "label", "body").mapInArrow(confirm, "a bigint, b bigint")


def confirmed_pairs(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs whose full sets are similar enough.

    pairs: leaf, hub. texts: node, n_bytes, body. A hub meets its leaves in cells of BLOCK leaves and CELL_BYTES of
    text on average; each leaf's text goes to its hubs only, the hub's to its cells.
    """
    sized = pairs.join(texts.select(F.col("node").alias("leaf"), "n_bytes"), "leaf")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_bytes") / CELL_BYTES)).cast("long")
    hubs = durable(sized.groupBy("hub").agg(parts.alias("parts")), "hubs")
    leaves = pairs.join(hubs, "hub").select(F.col("leaf").alias("node"), F.col("hub").alias("key"), F.pmod(F.xxhash64("leaf"), "parts").alias("part"), F.lit(False).alias("left"))
    cells = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    centres = hubs.select(F.col("hub").alias("node"), F.col("hub").alias("key"), cells, F.lit(True).alias("left"))
    # Where nodes go grows with the corpus, so it is not sent to all tasks, however small it is today.
    dealt = leaves.unionByName(centres).hint("merge").join(texts.select("node", "body"), "node").withColumns({"right": ~F.col("left"), "label": F.col("node")})
    return _confirmed(dealt.repartition("key", "part").sortWithinPartitions(*CELL), percent)


def confirmed_groups(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """a, b: links enough to connect all that is similar enough in groups whose members all meet.

    members: key, node, label, members, blocks.
    """
    some_large = not members.filter("blocks > 1").isEmpty()
    return _confirmed(_rest(members.hint("merge").join(texts.select("node", "body"), "node"), "node", some_large), percent)


def linked_classes(docs: DataFrame, classes: DataFrame, percent: int, *, id_col: str, text_col: str) -> DataFrame:
    """node, component of the classes that links tie together.

    First each member of a bucket meets one other in full, the smallest that looks similar. Then what looks similar
    and isn't tied yet hangs together in groups. Where a group has few such pairs for its size they meet as pairs,
    otherwise all its members meet in cells, whichever takes fewer copies of texts.
    """
    crowded = crowded_buckets(classes)
    some_large = not crowded.filter("blocks > 1").isEmpty()
    candidates = crowded.select(F.col("rep").alias("node")).distinct()
    # Rows that carry one id are one node, whatever their texts. The candidates grow with the corpus: no broadcast.
    bodies = docs.select(F.col(id_col).alias("node"), text_or_empty(text_col).alias("body"))
    texts = durable(bodies.join(candidates.hint("merge"), "node", "left_semi").select("node", F.octet_length("body").alias("n_bytes"), "body"), "candidates")
    rows = crowded.withColumns({"label": F.col("rep"), "tried": F.lit(-1).cast("long")})
    firsts = _similar_pairs(star_cells(rows, "key", "rep"), percent / 100, "first").groupBy("leaf").agg(F.min("hub").alias("hub"))
    firsts = durable(firsts, "pairs")
    links = durable(confirmed_pairs(firsts, texts, percent), "links")
    # Two links upwards are enough of a label: equal ones hang together, and most of a family has one.
    up = links.select(F.col("b").alias("rep"), F.col("a").alias("hub"))
    higher = links.select(F.col("b").alias("hub"), F.col("a").alias("above"))
    labels = up.join(higher, "hub", "left").select("rep", F.coalesce("above", "hub").alias("label")).dropDuplicates(["rep"])
    rows = crowded.join(labels, "rep", "left").join(firsts.select(F.col("leaf").alias("rep"), F.col("hub").alias("tried")), "rep", "left")
    rows = rows.withColumns({"label": F.coalesce("label", "rep"), "tried": F.coalesce("tried", F.lit(-1).cast("long"))})
    open_pairs = durable(_similar_pairs(_rest(rows, "rep", some_large), percent / 100, "forest"), "open")
    if not open_pairs.isEmpty():
        groups = durable(components(open_pairs.select(F.col("leaf").alias("a"), F.col("hub").alias("b"))), "groups")
        counts = open_pairs.filter("leaf = hub").groupBy(F.col("leaf").alias("node")).agg(F.sum("n").alias("n"))
        sized = groups.join(counts, "node", "left").join(texts.groupBy("node").agg(F.sum("n_bytes").alias("n_bytes")), "node")
        blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_bytes") / CELL_BYTES))
        plan = sized.groupBy("component").agg(F.count(F.lit(1)).alias("members"), blocks.cast("int").alias("blocks"), F.sum("n").alias("pairs"))
        plan = durable(plan.withColumn("dense", F.col("pairs") > F.col("members") * F.greatest(F.lit(FEW_PAIRS), F.col("blocks"))), "plan")
        planned = groups.join(plan, "component").select(F.col("node").alias("rep"), F.col("component").alias("group"), F.col("members").alias("n_group"), F.col("blocks").alias("n_blocks"), "dense")
        if not plan.filter("not dense").isEmpty():
            sparse = rows.join(planned.filter("not dense").select("rep"), "rep")
            pairs = _similar_pairs(_rest(sparse, "rep", some_large), percent / 100, "all").select(F.greatest("leaf", "hub").alias("leaf"), F.least("leaf", "hub").alias("hub")).distinct()
            links = links.unionByName(durable(confirmed_pairs(durable(pairs, "pairs"), texts, percent), "links"))
        if not plan.filter("dense").isEmpty():
            known = rows.select("rep", "label").distinct()
            dense = planned.filter("dense").join(known, "rep").select(F.col("group").alias("key"), F.col("rep").alias("node"), "label", F.col("n_group").alias("members"), F.col("n_blocks").alias("blocks"))
            links = links.unionByName(durable(confirmed_groups(durable(dense, "dense"), texts, percent), "links"))
    out = components(links)
    for table in (crowded, texts, open_pairs, firsts):
        forget(table)
    return out


def near_duplicates(docs: DataFrame, *, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept. Links: 100 * intersection >= percent * union."""
    require(docs, id_col, text_col)
    docs = docs.withColumn(id_col, F.col(id_col).cast("long"))
    signed = durable(signatures(docs, id_col=id_col, text_col=text_col), "signatures")
    first = F.min_by(F.struct("n_shingles", "bands", "bits"), F.col("id")).alias("of")
    by_class = signed.filter("id is not null and n_shingles > 0").groupBy("class").agg(F.min("id").alias("rep"), first)
    classes = durable(by_class.select("class", "rep", "of.n_shingles", "of.bands", "of.bits"), "classes")
    labels = linked_classes(docs, classes, percent, id_col=id_col, text_col=text_col)
    found = classes.select("class", "rep").join(labels, F.col("node") == F.col("rep"), "left").select("class", F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "n_shingles", "class").join(found, "class", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    out = out.select("id", "n_shingles", component.alias("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
    )


def deduplicate(docs: DataFrame, *, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns: one of each component. Rows with a null id stay."""
    gone = near_duplicates(docs, percent=percent, id_col=id_col, text_col=text_col).filter(~F.col("kept") & F.col(id_col).isNotNull())
    return docs.join(gone.select(id_col).distinct(), id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
