"""Removal of word sequences that an earlier document already has, by fixed-block anchors.

Words are maximal runs other than 0x20 and 0x09-0x0D. A window is `window` consecutive words of one
document; each word covered by a window that also starts in a document with a smaller id goes.

1. Anchors. Every document is cut into non-overlapping blocks of `window // 2` words, which make the
   index; every rolling window of that length probes it. A repeat of `window` words holds a whole block of
   the document on either side, so it is hit on both. Fingerprints travel packed, a few bytes a word, in
   one row for each hash partition and chunk of text.
2. Hits are extended: in the texts that have hits, the words of each window around them are digested
   (128 bits of BLAKE2b), and a window's smallest document is found by a minimum, combined before the
   shuffle. Windows of other documents are repeats, and neighbouring ones join to maximal repeats.

There is no list of pairs: a passage that many documents share costs each of them its own length.
Anchors use 40 bits and those that say which part they go to; a false hit costs a look at a few windows.
The parts follow from the size of the input, so that the blocks of one fit in a task's memory. Fingerprints
only propose; what counts as a repeat is told by the digest of the window's words.

Defined results: null and empty texts have no words. Rows with a null id are left as they are and are
no one's earlier document. Rows that share an id are one document: none of them is earlier than another.
A text of any length is read whole. Repeated rows give repeated results; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import durable, require, text_or_empty, text_slices
from millrace.llm.grouped import group_bounds, whole_groups
from millrace.llm.wordhash import Words, ranges, window_digests, windows, words_of

#: Bytes of text whose blocks make a part, and the most parts there are (a part then holds more).
PART_BYTES, MOST_PARTS = 32 << 20, 1 << 17
#: Bytes of text whose fingerprints travel together: at least, at most, and for each part.
CHUNK_BYTES, CHUNK_BYTES_MOST, CHUNK_BYTES_A_PART = 8 << 20, 64 << 20, 512
TAIL_BITS = 40
PRINT = ["print", "other"]
BLOCKS, PROBES, DOCS = 0, 1, 2
CHUNK_SCHEMA = "part int, kind int, chunk bigint, gaps binary, tails binary, ids binary, counts binary, words binary, digests binary"
COLUMNS = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in COLUMNS[3:]]])


def pack_gaps(places: np.ndarray) -> bytes:
    """Ascending places as one byte each: the distance from the one before, with 255 for 255 more to go."""
    steps = np.diff(places, prepend=-1) - 1
    extra = steps // 255
    out = np.full(len(steps) + int(extra.sum()), 255, dtype=np.uint8)
    out[np.arange(len(steps)) + np.cumsum(extra)] = (steps % 255).astype(np.uint8)
    return out.tobytes()


def unpack_gaps(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, dtype=np.uint8).astype(np.int64)
    last = steps < 255
    return (np.cumsum(steps + last) - 1)[last]


def pack_tails(hashes: np.ndarray) -> bytes:
    """The low 40 bits of each: all low 32, then all high 8."""
    return hashes.astype(np.uint32).tobytes() + (hashes >> np.uint64(32)).astype(np.uint8).tobytes()


def unpack_tails(packed: bytes) -> np.ndarray:
    n = len(packed) // (TAIL_BITS // 8)
    return np.frombuffer(packed, np.uint32, n).astype(np.uint64) | np.frombuffer(packed, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)


def _sha(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def _chunks(batches: Iterator[pa.RecordBatch], parts: int, block: int) -> Iterator[pa.RecordBatch]:
    """Packed fingerprints of chunks of documents: blocks and probes for each part, and the documents themselves."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    chunk_bytes = min(max(CHUNK_BYTES, CHUNK_BYTES_A_PART * parts), CHUNK_BYTES_MOST)
    for batch in batches:
        for piece in text_slices(batch, "body", chunk_bytes):
            hashes, kinds, ids, counts, n_words, digests = [], [], [], [], [], []
            for part in text_slices(piece, "body"):
                body = part.column("body")
                words = words_of(body)
                count = np.maximum(words.counts - block + 1, 0)
                starts = ranges(words.first[:-1], count)
                hashes.append(windows(words, block)[starts])
                kinds.append((starts - np.repeat(words.first[:-1], count)) % block == 0)
                ids.append(part.column("id").to_numpy())
                counts.append(count)
                n_words.append(words.counts)
                digests += [_sha(b" ".join(t.encode().split())) for t in body.to_pylist()]
            h, aligned = np.concatenate(hashes), np.concatenate(kinds)
            where = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            rows: list[tuple] = []
            for kind, chosen in ((BLOCKS, aligned), (PROBES, ~aligned)):
                places = np.flatnonzero(chosen)
                order = places[np.argsort(where[places], kind="stable")]
                bounds = np.searchsorted(where[order], np.arange(parts + 1, dtype=np.uint64))
                for p in range(parts):
                    own = order[bounds[p] : bounds[p + 1]]
                    if len(own):
                        rows.append((p, kind, number, pack_gaps(own), pack_tails(h[own]), None, None, None, None))
            packed = [np.concatenate(x).astype(np.int64).tobytes() for x in (ids, counts, n_words)]
            rows.append((number % parts, DOCS, number, None, None, *packed, b"".join(digests)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
            number += 1


class _Anchors:
    """The blocks of one part: distinct tails, where each was first seen, and which are repeats."""

    def __init__(self):
        self.tails = np.zeros(0, dtype=np.uint64)
        self.chunk, self.place = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.told = np.zeros(0, dtype=bool)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, tails: np.ndarray, chunk: int, places: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        self.waiting.append((tails, np.full(len(tails), chunk), places.astype(np.int32)))
        self.held += len(tails)
        return self.merge() if self.held > max(200_000, len(self.tails) // 2) else []

    def merge(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Take in what waits; gives the (chunks, places) of blocks that turn out to be seen twice."""
        if not self.waiting:
            return []
        tails, chunk, place = (np.concatenate([old, *new]) for old, new in zip((self.tails, self.chunk, self.place), zip(*self.waiting, strict=True), strict=True))
        told = np.concatenate((self.told, np.zeros(len(tails) - len(self.told), dtype=bool)))
        order = np.argsort(tails, kind="stable")
        tails, chunk, place, told = tails[order], chunk[order], place[order], told[order]
        first = np.ones(len(tails), dtype=bool)
        first[1:] = tails[1:] != tails[:-1]
        group = np.cumsum(first) - 1
        repeated = np.bincount(group)[group] > 1
        new = repeated & ~told
        out = [(chunk[new], place[new])]
        self.tails, self.chunk, self.place, self.told = tails[first], chunk[first], place[first], (told | repeated)[first]
        self.waiting, self.held = [], 0
        return out

    def probe(self, tails: np.ndarray, chunk: int, places: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(chunks, places) of the probes that hit a block, and of blocks that are hit for the first time."""
        at = np.searchsorted(self.tails, tails)
        at[at == len(self.tails)] = 0
        hit = self.tails[at] == tails if len(self.tails) else np.zeros(len(tails), dtype=bool)
        if not hit.any():
            return []
        own = np.unique(at[hit])
        own = own[~self.told[own]]
        self.told[own] = True
        return [(np.full(int(hit.sum()), chunk), places[hit].astype(np.int32)), (self.chunk[own], self.place[own])]


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by part and kind: hits by chunk, and the rows of documents as they came."""
    schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("places", pa.binary()), *[(c, pa.binary()) for c in COLUMNS[5:]]])
    part, anchors = None, _Anchors()

    def batch_of(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        found = [f for f in found if len(f[0])]
        if not found:
            return
        chunk, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(chunk, kind="stable")
        chunk, place = chunk[order], place[order]
        names, first = np.unique(chunk, return_index=True)
        packed = [p.astype(np.int32).tobytes() for p in np.split(place, first[1:])]
        none = pa.nulls(len(names), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([PROBES] * len(names), pa.int32()), pa.array(packed, pa.binary()), none, none, none, none], schema=schema)

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != part:
                yield from batch_of(anchors.merge())
                part, anchors = row["part"], _Anchors()
            if row["kind"] == DOCS:
                yield pa.RecordBatch.from_pylist([{"chunk": row["chunk"], "kind": DOCS, "places": None, **{c: row[c] for c in COLUMNS[5:]}}], schema=schema)
                continue
            tails, places = unpack_tails(row["tails"]), unpack_gaps(row["gaps"])
            if row["kind"] == BLOCKS:
                yield from batch_of(anchors.add(tails, row["chunk"], places))
            else:
                yield from batch_of(anchors.merge())
                yield from batch_of(anchors.probe(tails, row["chunk"], places))
    yield from batch_of(anchors.merge())


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by chunk, documents first: id, n_words, digest, and the hits as starts within the document."""
    for group in whole_groups(batches, ["chunk"]):
        bounds = group_bounds(group, ["chunk"])
        for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            rows = group.slice(begin, end - begin).to_pylist()
            docs = next(r for r in rows if r["kind"] == DOCS)
            ids, counts, n_words = (np.frombuffer(docs[c], dtype=np.int64) for c in ("ids", "counts", "words"))
            places = np.sort(np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(r["places"], dtype=np.int32) for r in rows if r["kind"] != DOCS]])).astype(np.int64)
            first = np.concatenate(([0], np.cumsum(counts)))
            cut = np.searchsorted(places, first)
            starts = [(places[cut[i] : cut[i + 1]] - first[i]).astype(np.int32).tobytes() if cut[i + 1] > cut[i] else None for i in range(len(ids))]
            digests = [docs["digests"][32 * i : 32 * i + 32] for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(n_words), pa.array(digests, pa.binary()), pa.array(starts, pa.binary())], names=["id", "n_words", "digest", "hits"]
            )


def _around(words: Words, hits: list[bytes], window: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document the starts of windows that hold a hit (relative, one array for all), and how many."""
    starts, number = [], []
    for count, packed in zip(words.counts.tolist(), hits, strict=True):
        hit = np.frombuffer(packed, dtype=np.int32).astype(np.int64)
        low, high = np.maximum(hit - (window - block), 0), np.minimum(hit, count - window)
        own = np.unique(ranges(low, high - low + 1)) if count >= window else np.zeros(0, dtype=np.int64)
        starts.append(own)
        number.append(len(own))
    return (np.concatenate(starts) if starts else np.zeros(0, np.int64)), np.array(number, dtype=np.int64)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, n_words, digest) of each row, and of those with repeats (id, digest, body, starts), repeated rows too.

    digest is the SHA-256 of a row's words joined by one space; starts are the first words of the windows to go.
    """
    require(docs, id_col, text_col)
    block = window // 2
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("body"))
    known = rows.filter("id is not null")
    held = known.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    parts = min(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // PART_BYTES)), MOST_PARTS)
    packed = known.mapInArrow(lambda b: _chunks(b, parts, block), CHUNK_SCHEMA)
    dealt = packed.repartition(parts, "part").sortWithinPartitions("part", "kind", "chunk")
    found = dealt.mapInArrow(_hits, "chunk bigint, kind int, places binary, ids binary, counts binary, words binary, digests binary")
    located = found.repartition("chunk").sortWithinPartitions("chunk", F.desc("kind"))
    documents = durable(located.mapInArrow(_by_document, "id bigint, n_words bigint, digest binary, hits binary"), "anchored")
    hit = documents.filter(F.col("hits").isNotNull() & (F.col("n_words") >= window)).select("id", "digest", "hits").distinct()
    # A row's text is told by its id and digest; rows that share both are one here.
    candidates = known.join(hit, "id")

    def own_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "body"):
                pairs = zip(part.column("body").to_pylist(), part.column("digest").to_pylist(), strict=True)
                yield part.filter(pa.array([_sha(b" ".join(t.encode().split())) == d for t, d in pairs], pa.bool_()))

    candidates = candidates.select("id", "digest", "hits", "body")
    extended = durable(candidates.mapInArrow(own_text, candidates.schema), "extended")

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "body"):
                words = words_of(part.column("body"))
                starts, number = _around(words, part.column("hits").to_pylist(), window, block)
                texts = part.column("body").to_pylist()
                cut = np.cumsum(number)[:-1]
                digests = [window_digests(t, own, window) for t, own in zip(texts, np.split(starts, cut), strict=True) if len(own)]
                both = np.concatenate(digests) if digests else np.zeros((0, 2), dtype=np.int64)
                prints = [pa.array(both[:, 0]), pa.array(both[:, 1])]
                rows = pa.array(np.repeat(np.arange(part.num_rows), number))
                columns = [part.column("id").take(rows), part.column("mark").take(rows), pa.array(starts.astype(np.int32)), *prints]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "start", *PRINT])

    # Half a digest is enough to tell the texts of one id.
    marked = extended.select("id", F.substring("digest", 1, 16).alias("mark"), "hits", "body")
    each = marked.mapInArrow(around, "id bigint, mark binary, start int, print bigint, other bigint")
    first = each.groupBy(*PRINT).agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    # A table of its own: a print that very many documents share is then a skewed join, which Spark splits.
    first = durable(first.select(*PRINT, "least"), "first")
    later = each.join(first, PRINT).filter("id > least").groupBy("id", "mark").agg(F.collect_set("start").alias("starts"))
    texts = extended.select("id", "digest", F.substring("digest", 1, 16).alias("mark"), "body")
    left_out = rows.filter("id is null")
    if not left_out.isEmpty():
        said = _words(F.col("body"))
        nameless = left_out.select("id", F.size(said).cast("long").alias("n_words"), F.unhex(F.sha2(F.array_join(said, " "), 256)).alias("digest"))
        documents = documents.select("id", "n_words", "digest").unionByName(nameless)
    return documents.select("id", "n_words", "digest"), texts.join(later, ["id", "mark"]).drop("mark")


def remove_repeats(docs: DataFrame, *, window: int = 50, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256, spans (maximal repeats, in words), kept_text.

    spans and kept_text are null for rows without repeats, whose words all stay, and left out without with_text.
    """
    documents, repeats = repeated_words(docs, window=window, id_col=id_col, text_col=text_col)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "body"):
                removed, spans, texts, digests = [], [], [], []
                for body, starts in zip(part.column("body").to_pylist(), part.column("starts").to_pylist(), strict=True):
                    words = body.encode().split()
                    cover = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(cover, starts, 1)
                    np.subtract.at(cover, np.array(starts) + window, 1)
                    gone = np.cumsum(cover)[:-1] > 0
                    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                    removed.append(int(gone.sum()))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                    texts.append(kept.decode())
                    digests.append(_sha(kept))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("digest"), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(texts, pa.string()), pa.array(digests, pa.binary())],
                    names=["rid", "rdigest", "n_removed", "spans", "kept_text", "kept"],
                )

    shorter = repeats.select("id", "digest", "body", "starts").mapInArrow(
        cut, "rid bigint, rdigest binary, n_removed bigint, spans array<struct<start:int,end:int>>, kept_text string, kept binary"
    )
    # Repeated rows have the same result.
    wanted = ["n_removed", "kept", *(["spans", "kept_text"] if with_text else [])]
    shorter = shorter.select("rid", "rdigest", *wanted).dropDuplicates(["rid", "rdigest"])
    out = documents.join(shorter, (F.col("id") == F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.lower(F.hex(F.coalesce("kept", "digest"))).alias("kept_sha256"),
        *wanted[2:],
    )
