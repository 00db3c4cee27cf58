"""Vectorised word and word-window fingerprints over Arrow string columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. A word's fingerprint is a sum of 64-bit
values that a mixer makes of each byte together with its place in the word, so words built from a pattern
(such as a letter sequence and its complement) do not meet. A window's fingerprint is a polynomial over its
words' fingerprints modulo 2**64, followed by the mixer. All come from prefix sums, so the cost does not
depend on word or window length. Fingerprints propose; whoever decides compares words or their digests
(exact_shingles() here, window_digests() for windows).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PLACE = np.uint64(0x9E3779B97F4A7C15)
BASE_WORD = 0xD1342543DE82EF95

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_KEPT = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; arrays of up to _KEPT entries stay for the next call."""
    held = _powers.get(base)
    if held is not None and len(held[0]) >= n:
        return held[0][:n], held[1][:n]
    size = max(n, 1 << 16)
    made = []
    for b in (base, pow(base, -1, 1 << 64)):
        a = np.full(size, b, dtype=np.uint64)
        a[0] = 1
        made.append(np.cumprod(a, dtype=np.uint64))
    if size <= _KEPT:
        _powers[base] = (made[0], made[1])
    return made[0][:n], made[1][:n]


@dataclass
class Words:
    """Words of some documents: byte spans, fingerprints, and the index of each document's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len(docs) + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words_of(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = column_bytes(column)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none, none, none.astype(np.uint64), np.zeros(len(offsets), dtype=np.int64))
    inside = ~_SEPARATOR[data]
    opens = np.zeros(n + 1, dtype=bool)
    opens[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | opens[1:n]
    ends[:-1] &= ~inside[1:] | opens[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    length = end - start
    stop = np.cumsum(length)
    place = np.arange(int(stop[-1]) if len(stop) else 0, dtype=np.uint64) - np.repeat((stop - length).astype(np.uint64), length)
    sums = np.zeros(len(place) + 1, dtype=np.uint64)
    np.cumsum(mix((place * np.uint64(256) + data[inside].astype(np.uint64) + np.uint64(1)) * PLACE), out=sums[1:])
    hashes = mix(sums[stop] - sums[stop - length] + length.astype(np.uint64))
    return Words(data, start, end, hashes, np.searchsorted(start, offsets))


def windows(words: Words, size: int, base: int = BASE_WORD) -> np.ndarray:
    """Fingerprints of the windows of `size` words that start at each word; those past the last full one are not to be used."""
    n = len(words.hash)
    if not n:
        return words.hash
    up, down = powers(base, n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words.hash * up, out=sums[1:])
    stop = np.minimum(np.arange(n) + size, n)
    return mix((sums[stop] - sums[:n]) * down + np.uint64(size))


def spans_hash(words: Words, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Fingerprints of the word sequences [start, stop)."""
    n = len(words.hash)
    if not n:
        return np.zeros(len(start), dtype=np.uint64)
    up, down = powers(BASE_WORD, n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words.hash * up, out=sums[1:])
    return mix((sums[stop] - sums[start]) * down[np.minimum(start, n - 1)] + (stop - start).astype(np.uint64))


def exact_shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of each text's word sequences of `size` words, in order and with repeats, and how many each text has.

    Equal numbers stand for equal words, A-Z in either case: words get numbers from a dictionary, and sequences
    from the pairs of a shorter sequence and its next word. A text of fewer words is one sequence.
    """
    known: dict[bytes, int] = {}
    split = [t.encode().lower().split() for t in texts]
    counts = np.array([len(w) for w in split], dtype=np.int64)
    word = np.fromiter((known.setdefault(w, len(known) + 1) for words in split for w in words), dtype=np.int64, count=int(counts.sum()))
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    start, stop = ranges(first, number), np.repeat(first + counts, number)
    now = np.zeros(len(start), dtype=np.int64)
    for step in range(size):
        # 0 where the text has ended.
        following = np.where(start + step < stop, word[np.minimum(start + step, max(len(word) - 1, 0))], 0) if len(start) else now
        now = np.unique(now * (len(known) + 1) + following, return_inverse=True)[1]
    return now, number


def window_digests(text: str, starts: np.ndarray, size: int) -> np.ndarray:
    """(len(starts), 2): 128 bits of BLAKE2b of the `size` words that begin at each start, joined by one space."""
    words = text.encode().split()
    joined = b" ".join(words)
    begin = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))
    spans = zip(begin[starts].tolist(), (begin[starts + size] - 1).tolist(), strict=True)
    digests = b"".join([hashlib.blake2b(joined[a:b], digest_size=16).digest() for a, b in spans])
    return np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + length), one range after the other."""
    length = np.maximum(length, 0)
    total = int(length.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    offset = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length)
    return offset + np.arange(total)
