"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are brought to lower-case words with single spaces. An item is searched for as
segments of SEGMENT characters, one every STEP characters and one at its end (a shorter item is one
segment), so a passage quoted in part is found too: any verbatim quote of SEGMENT + STEP - 1 characters
holds a whole segment. If a region of a text is within k edits of a segment of n characters, they share at
least n + 1 - (k + 1) * q q-grams whose diagonals (place in text minus place in segment) differ by k at
most. Shared q-grams are counted in diagonal bands of width 2 * (k + 1) that overlap by half; bands that
reach the bound, each gram of a segment counted once, are verified by a banded alignment (after a bit-
parallel bound on the edits), so what is reported is within the budget exactly, and no region within a
segment's budget is missed.

The budget is a tenth of the segment as far as the lemma still gives a bound: none under 2 * Q characters,
where the words must stand in the text as they are, from one word's beginning to another's end. An item
under Q characters has no q-gram and would stand in most texts by chance: it matches a text that is the
item, after normalisation.

The benchmark is taken in blocks of bounded size, one after the other: a block's index goes to the tasks
that read the texts, and with more than one block each block's matches (no texts) are a written table before
the next block is read; one join brings them back to the rows. A text is read whole, whatever its length, in
stretches of bounded size; what repeats itself is counted and aligned once. Of places of one segment that
overlap, the best is told.

Defined results: null and empty texts match nothing, as do null items and items without a letter or digit;
an empty benchmark matches nothing. Repeated rows give repeated results; repeated items report each; extra
columns pass through find_passages() unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import durable, forget, require, text_slices
from millrace.llm.wordhash import ranges

Q = 8
SEGMENT, STEP = 100, 25
EDIT_RATE = 0.1
#: Characters of benchmark text in a block.
BLOCK_CHARS = 2_000_000
FILTER_BITS = 22
#: Characters of a piece and of a stretch of it, and those that neighbouring ones share: more than a region has.
PIECE, STRETCH, OVERLAP = 1 << 18, 2048, 256
#: Pairs of a gram and a place that are held at once, and stretches or bands that are remembered.
MOST_PAIRS, REMEMBERED = 1_000_000, 2048
_GRAM = 0x9E3779B97F4A7C15
_SPREAD = np.uint64(0xD1342543DE82EF95)
MATCH = "struct<item_id:{0},start:int,end:int,distance:int>"

# What each character of the basic plane counts as: its small letter, and whether it is a letter or digit.
_SMALL = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(1 << 16))], dtype=np.uint32)
_COUNTS = np.array([chr(c).isalnum() for c in range(1 << 16)], dtype=bool)


def normalise(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Small letters and digits with single spaces between, as code points, and the place of each in the text."""
    chars = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    held = np.minimum(chars, 0xFFFF)
    word, small = _COUNTS[held], _SMALL[held]
    beyond = np.flatnonzero(chars > 0xFFFF)
    if len(beyond):
        signs, which = np.unique(chars[beyond], return_inverse=True)
        said = [chr(c) for c in signs.tolist()]
        word[beyond] = np.array([c.isalnum() for c in said])[which]
        small[beyond] = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in said], dtype=np.uint32)[which]
    keep = word.copy()
    keep[1:] |= word[:-1]  # one space after a word
    places = np.flatnonzero(keep)
    return np.where(word[places], small[places], np.uint32(32)), places


def _bare(text: str | None) -> np.ndarray:
    chars, _ = normalise(text)
    return chars[:-1] if len(chars) and chars[-1] == 32 else chars


def gram_hashes(chars: np.ndarray) -> np.ndarray:
    """A polynomial over each Q characters in a row, by doubling."""
    n = len(chars) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h, size = chars.astype(np.uint64), 1
    while size < Q:
        h = h[:-size] * np.uint64(pow(_GRAM, size, 1 << 64)) + h[size:]
        size *= 2
    return h


def budget(length: int) -> int:
    """Edits allowed in a segment: EDIT_RATE of its length, as far as the lemma still gives a bound."""
    return max(0, min(int(EDIT_RATE * length), length // Q - 1))


@dataclass
class Segment:
    item: object
    chars: np.ndarray
    edits: int

    @cached_property
    def masks(self) -> dict[int, int]:
        """Of each character, the bits of its places."""
        out: dict[int, int] = {}
        for i, c in enumerate(self.chars.tolist()):
            out[c] = out.get(c, 0) | 1 << i
        return out

    @property
    def least_shared(self) -> int:
        return len(self.chars) + 1 - (self.edits + 1) * Q


def segments_of(item_id: object, text: str | None) -> list[Segment]:
    chars = _bare(text)
    if not len(chars):
        return []
    if len(chars) <= SEGMENT:
        starts, size = [0], len(chars)
    else:
        starts = sorted({*range(0, len(chars) - SEGMENT + 1, STEP), len(chars) - SEGMENT})
        size = SEGMENT
    return [Segment(item_id, chars[s : s + size], budget(size)) for s in starts]


class Index:
    """The q-grams of a block of segments: sorted hashes, and where each occurs."""

    def __init__(self, segments: list[Segment]):
        # Those without a q-gram are looked up as whole texts.
        self.tiny: dict[bytes, list[object]] = {}
        for s in segments:
            if len(s.chars) < Q:
                self.tiny.setdefault(s.chars.tobytes(), []).append(s.item)
        segments = [s for s in segments if len(s.chars) >= Q]
        self.segments = segments
        self.edits = np.array([s.edits for s in segments], dtype=np.int64)
        self.least = np.array([s.least_shared for s in segments], dtype=np.int64)
        hashes = [gram_hashes(s.chars) for s in segments]
        every = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        segment = np.repeat(np.arange(len(segments), dtype=np.int32), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h), dtype=np.int32) for h in hashes]) if hashes else np.zeros(0, dtype=np.int32)
        order = np.argsort(every, kind="stable")
        self.known, first, count = np.unique(every[order], return_index=True, return_counts=True)
        self.first, self.count = first.astype(np.int32), count.astype(np.int32)
        self.segment, self.place = segment[order], place[order]
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self._slot(self.known)] = True

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return ((hashes * _SPREAD) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def regions(self, chars: np.ndarray) -> Iterator[tuple[int, int]]:
        """(segment, first diagonal) of the bands of `chars` that reach their segment's bound.

        The text is read in pieces that overlap by more than a region. A piece with very many shared grams is counted
        in stretches, and a stretch that was there before, as in a text that repeats itself, isn't counted again.
        """
        seen: dict[bytes, list[tuple[int, int]]] = {}
        for begin in range(0, max(len(chars) - OVERLAP, 1), PIECE - OVERLAP):
            piece = chars[begin : begin + PIECE]
            at, found = self._shared(piece)
            if not len(at):
                continue
            if int(self.count[found].sum()) <= MOST_PAIRS:
                for segment, first in self._bands(piece, at, found):
                    yield segment, first + begin
                continue
            for inner in range(0, max(len(piece) - OVERLAP, 1), STRETCH - OVERLAP):
                stretch = piece[inner : inner + STRETCH]
                key = stretch.tobytes()
                if key not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[key] = self._bands(stretch, *self._shared(stretch))
                for segment, first in seen[key]:
                    yield segment, first + begin + inner

    def _shared(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the q-grams of chars that some segment has, and which they are."""
        hashes = gram_hashes(chars)
        if not len(hashes) or not len(self.known):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.filter[self._slot(hashes)])
        found = np.searchsorted(self.known, hashes[at])
        found[found == len(self.known)] = 0
        real = self.known[found] == hashes[at]
        return at[real], found[real]

    def _bands(self, chars: np.ndarray, at: np.ndarray, found: np.ndarray) -> list[tuple[int, int]]:
        if not len(at):
            return []
        # Very frequent grams are counted for some segments at a time.
        pairs = int(self.count[found].sum())
        slices = min(-(-pairs // MOST_PAIRS), len(self.segments))
        if slices == 1:
            return self._bands_of(chars, at, self.first[found].astype(np.int64), self.count[found])
        cuts, room = np.linspace(0, len(self.segments), slices + 1).astype(np.int64), len(self.segments) + 1
        out = []
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            first, last = (np.searchsorted(self.sorted_by_gram, found * room + s) for s in (low, high))
            out += self._bands_of(chars, at, first, last - first)
        return out

    @cached_property
    def sorted_by_gram(self) -> np.ndarray:
        gram = np.repeat(np.arange(len(self.known), dtype=np.int64), self.count)
        return gram * (len(self.segments) + 1) + self.segment

    def _bands_of(self, chars: np.ndarray, at: np.ndarray, first: np.ndarray, times: np.ndarray) -> list[tuple[int, int]]:
        entry = ranges(first, times)
        if not len(entry):
            return []
        segment, at = self.segment[entry].astype(np.int64), np.repeat(at, times)
        # A segment that shares too few grams with all of the text has no band that shares enough.
        enough = np.bincount(segment, minlength=len(self.segments)) >= self.least
        if not enough.any():
            return []
        some = enough[segment]
        entry, segment, at = entry[some], segment[some], at[some]
        diagonal = at - self.place[entry]
        base = len(chars) + SEGMENT  # keeps strips positive
        room = 2 * base + 2
        strips, number = np.unique(segment * room + (diagonal + base) // (self.edits[segment] + 1), return_counts=True)
        # A band is two neighbouring strips of k + 1 diagonals: the shared grams of a region lie in the band
        # that begins with the strip of their least diagonal.
        following = np.zeros(len(strips), dtype=np.int64)
        following[:-1] = np.where(strips[1:] == strips[:-1] + 1, number[1:], 0)
        of, strip = strips // room, strips % room
        enough = number + following >= self.least[of]
        if not enough.any():
            return []
        # A gram of the segment may be shared at several diagonals of a band, and counts once.
        order = np.lexsort((diagonal, segment))
        segment, diagonal, place = segment[order], diagonal[order], self.place[entry][order]
        found = []
        for s, first_one in zip(of[enough].tolist(), (strip * (self.edits[of] + 1) - base)[enough].tolist(), strict=True):
            begin, end = np.searchsorted(segment, (s, s + 1))
            low, high = begin + np.searchsorted(diagonal[begin:end], (first_one, first_one + 2 * (int(self.edits[s]) + 1)))
            if high - low >= self.least[s] and len(set(place[low:high].tolist())) >= self.least[s]:
                found.append((s, first_one))
        return found


def least_edits(segment: Segment, chars: np.ndarray, first: int, width: int) -> int:
    """No more than the edits of align() over the same band, and quick: the whole region, one machine word of bits a row."""
    begin, end = max(0, first - segment.edits), min(len(chars), first + width + segment.edits + len(segment.chars))
    n, masks = len(segment.chars), segment.masks
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best = n
    for c in chars[begin:end].tolist():
        same = masks.get(c, 0)
        x = same | down
        d = (((x & up) + up) ^ up) | x
        plus, minus = down | (full & ~(d | up)), up & d
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            best = min(best, score)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(d | plus)), plus & d
    return best


def align(segment: np.ndarray, chars: np.ndarray, first: int, width: int, edits: int) -> tuple[int, int, int] | None:
    """The best place of the segment in chars with a start diagonal in [first, first + width): (edits, start, end).

    Edit distance of the whole segment to a part of chars, over the band of diagonals that the start and
    the edits allow; None if it is over the budget. Of equal distances the leftmost end counts.
    """
    low = first - edits
    band = width + 2 * edits
    n, far = len(segment), np.int64(1 << 30)
    # Column c of row i is the boundary i + low + c of chars. Places outside chars never match.
    padded = np.full(n + band + 1, 0xFFFFFFFF, dtype=np.uint32)
    begin, end = max(0, low), min(len(chars), low + n + band)
    if end > begin:
        padded[begin - low : end - low] = chars[begin:end]
    steps = np.arange(band)
    row = np.zeros(band, dtype=np.int64)
    rows = [row]
    for i in range(n):
        change = row + (padded[i : i + band] != segment[i])
        drop = np.append(row[1:], far) + 1
        new = np.minimum(change, drop)
        row = np.minimum.accumulate(new - steps) + steps
        rows.append(row)
    c = int(np.argmin(row))
    distance = int(row[c])
    if distance > edits:
        return None
    end_at, i = n + low + c, n
    while i:  # back along one best path, for the start
        here = rows[i][c]
        if rows[i - 1][c] + (padded[i - 1 + c] != segment[i - 1]) == here:
            i -= 1
        elif c + 1 < band and rows[i - 1][c + 1] + 1 == here:
            i, c = i - 1, c + 1
        else:
            c -= 1
    return distance, max(0, low + c), min(len(chars), end_at)


def _stands(segment: np.ndarray, chars: np.ndarray, start: int) -> bool:
    """Whether the segment stands at start as it is, from one word's beginning to another's end."""
    end = start + len(segment)
    if start < 0 or end > len(chars) or not np.array_equal(chars[start:end], segment):
        return False
    return (start == 0 or chars[start - 1] == 32) and (end == len(chars) or chars[end] == 32)


def passages(text: str | None, index: Index) -> list[tuple[object, int, int, int]]:
    """(item, start, end, edits) for each segment found, in places of the text."""
    chars, places = normalise(text)
    if len(chars) <= Q:
        bare = _bare(text)
        return [(item, int(places[0]), int(places[len(bare) - 1]) + 1, 0) for item in index.tiny.get(bare.tobytes(), ()) if len(bare)] + _regions_found(chars, places, index)
    return _regions_found(chars, places, index)


def _hits(segment: Segment, chars: np.ndarray, first: int) -> list[tuple[int, int, int]]:
    """(edits, start, end) of the segment in a band of chars."""
    width = 2 * (segment.edits + 1)
    if not segment.edits and len(segment.chars) < 2 * Q:
        return [(0, at, at + len(segment.chars)) for at in range(first, first + width) if _stands(segment.chars, chars, at)]
    if least_edits(segment, chars, first, width) > segment.edits:
        return []
    hit = align(segment.chars, chars, first, width, segment.edits)
    return [hit] if hit else []


def _regions_found(chars: np.ndarray, places: np.ndarray, index: Index) -> list[tuple[object, int, int, int]]:
    """Of places of one segment that overlap, the one with least edits is told (of ties the first)."""
    told: dict[int, list[tuple[int, int, int]]] = {}
    known: dict[tuple[int, int, bytes], list[tuple[int, int, int]]] = {}
    for which, first in index.regions(chars):
        segment = index.segments[which]
        # What a band gives depends on its characters only, and on where the text begins and ends.
        begin, stop = max(0, first - segment.edits - 1), first + 2 * (segment.edits + 1) + segment.edits + len(segment.chars) + 1
        key = (which, first - begin, chars[begin:stop].tobytes())
        if key not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[key] = [(d, a - first, b - first) for d, a, b in _hits(segment, chars, first)]
        own = told.setdefault(which, [])
        for d, a, b in known[key]:
            hit = (d, a + first, b + first)
            if own and hit[1] < own[-1][2] and own[-1][1] < hit[2]:
                if d < own[-1][0]:
                    own[-1] = hit
            else:
                own.append(hit)
    return [(index.segments[w].item, int(places[a]), int(places[max(a, b - 1)]) + 1, d) for w in sorted(told) for d, a, b in sorted(set(told[w]), key=lambda x: x[2])]


def _count_blocks(items: DataFrame) -> int:
    return -(-(items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0) // BLOCK_CHARS)


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    matches_col: str = "matches",
    only_clean: bool = False,
) -> DataFrame:
    """docs with an array of (item_id, start, end, distance): the parts of the text that stand for a benchmark item.

    With only_clean, the rows without any, as they are.
    """
    require(docs, text_col)
    require(benchmark, item_col, item_text_col)
    if matches_col in docs.columns:
        raise ValueError(f"docs already has a column {matches_col}")
    spark = docs.sparkSession
    item_field = benchmark.schema[item_col].dataType.simpleString()
    item_arrow = benchmark.select(item_col).limit(0).toArrow().schema.field(0).type
    match = pa.struct([("item_id", item_arrow), ("start", pa.int32()), ("end", pa.int32()), ("distance", pa.int32())])
    schema = f"key binary, {matches_col} array<{MATCH.format(item_field)}>"
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter(F.length("text") > 0)
    blocks = _count_blocks(items)
    none = F.expr(f"cast(array() as array<{MATCH.format(item_field)}>)")

    def searched(rows: DataFrame, block: int, out_schema: object, told) -> tuple[DataFrame, object]:
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(Index([s for r in part.toLocalIterator() for s in segments_of(r["item"], r["text"])]))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for piece in text_slices(batch, text_col):
                    hits = [[dict(zip(("item_id", "start", "end", "distance"), hit, strict=True)) for hit in passages(text, index)] for text in piece.column(text_col).to_pylist()]
                    yield told(piece, pa.array(hits, pa.list_(match)))

        return rows.mapInArrow(search, out_schema), shared

    if blocks == 0:
        return docs if only_clean else docs.withColumn(matches_col, none)
    if blocks == 1:  # the matches go with their rows
        wide = docs.withColumn(matches_col, none).schema
        names = wide.names
        told = lambda piece, hits: pa.RecordBatch.from_arrays([*piece.columns, hits], names=names)
        out, _ = searched(docs, 0, wide, told)
        return out.filter(F.size(matches_col) == 0).drop(matches_col) if only_clean else out
    # Texts are read once for each block, and only matches are written, by the digest of the text they belong to.
    digest, free = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)), next(n for k in range(len(docs.columns) + 1) if (n := f"__key{k}") not in docs.columns)
    rows, tables = docs.select(digest.alias("key"), F.col(text_col)), []

    def keyed(piece: pa.RecordBatch, hits: pa.Array) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([piece.column(0), hits], names=["key", matches_col])
        return out.filter(pa.compute.greater(pa.compute.list_value_length(hits), 0))

    for block in range(blocks):
        found, shared = searched(rows, block, schema, keyed)
        tables.append(durable(found.dropDuplicates(["key"]).withColumn("block", F.lit(block)), "passages"))
        shared.destroy()
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table)
    # A text's matches of all blocks, in their order: at most a list for each block.
    of_text = durable(every.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", matches_col))), lambda x: x[matches_col])).alias(matches_col)), "passages")
    for table in tables:
        forget(table)
    with_key, of_text = docs.withColumn(free, digest), of_text.withColumnRenamed("key", free)
    if only_clean:
        return with_key.join(of_text.select(free), free, "left_anti").drop(free)
    joined = with_key.join(of_text, free, "left").withColumn(matches_col, F.coalesce(matches_col, none))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], matches_col)


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, contaminated, number of items found, the items (sorted, comma-joined), least edits."""
    require(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    found = find_passages(rows, benchmark, text_col="body")
    items = F.array_sort(F.array_distinct(F.col("matches.item_id")))
    return found.select(
        F.col("id").alias(id_col),
        (F.size("matches") > 0).alias("contaminated"),
        F.size(items).cast("long").alias("n_items"),
        F.array_join(F.transform(items, lambda i: i.cast("string")), ",").alias("item_ids"),
        F.array_min(F.col("matches.distance")).alias("least_edits"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark passage, with their columns."""
    free = next(name for k in range(len(docs.columns) + 1) if (name := f"__matches{k}") not in docs.columns)
    return find_passages(docs, benchmark, text_col=text_col, matches_col=free, only_clean=True)
