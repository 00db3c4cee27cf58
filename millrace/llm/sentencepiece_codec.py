"""SentencePiece encoding by a streaming Viterbi search, and decoding.

stream() goes through a text character by character. Each boundary between characters keeps one back-
pointer, the last piece of the best segmentation up to it, and only boundaries from which a piece may still
go on keep their state, so the search's window is bounded by the longest piece. As soon as the paths back
from all of them pass through one boundary, the pieces before it are final and their ids are given out:
memory does not grow with the text. (Only a unigram model may keep several paths apart for long, through
one word repeated without spaces in several phases; their backpointers are held until they meet.)

What "best" means follows from how the model was trained:

- Unigram: the greatest sum of piece scores. Of equal sums the one whose last piece is longest is taken.
- BPE: scores are merge ranks, whose sums mean nothing. The segmentation that merging by rank leads to is
  the only one in which every piece, and every two neighbours, come out of merging by themselves as they
  are. So a piece may follow the last piece before it only if merging the two leaves both (Vocabulary.
  beside()); exactly one last piece is left at each boundary, and the same search applies. Ids are those
  of the library.

Where two adjacent characters stand side by side in no piece, every path has a boundary: before a space
mark, around line ends and before signs that no piece has after a word. Such places cut a text into
chunks that are searched one by one, and the answers of short chunks are remembered (in a bounded table),
since words repeat.

Characters that are no piece become the model's byte pieces; in a unigram search with a penalty below
every score. Spaces become the model's space mark, with one before the text; a space mark that the text
itself holds is spelled in bytes (the library reads it as a space). decode(encode(text)) is the text,
whatever the text is.

Defined results: null gives null ids, the empty text gives no ids; repeated rows give repeated results; a
text of any length is searched whole, in the same window; an empty table gives an empty result; extra
columns pass through encode() and decode() unread, whatever their names.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import require, text_slices

MARK = "▁"
#: How far below the least score a character without a piece lies.
UNKNOWN_PENALTY = 10.0
#: Chunks up to this length are remembered: so many in use, and as many from before. Likewise pairs of pieces.
REMEMBERED_LENGTH, REMEMBERED = 48, 300_000
REMEMBERED_PAIRS = 1_000_000
NO_SCORE = float("-inf")
NO_PIECE, NOTHING = -1, 1 << 30
#: Characters taken for parts of words where a text is cut into chunks; the cuts are right for any choice.
WORD = "A-Za-z0-9\u00c0-\u1fff"


class Vocabulary:
    """Pieces, scores and byte pieces of a SentencePiece model; reads the model once a worker."""

    def __init__(self, model: bytes):
        self.model = model
        self._ready = False

    def __getstate__(self):
        return {"model": self.model, "_ready": False}

    def load(self) -> Vocabulary:
        if self._ready:
            return self
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        size = m.get_piece_size()
        self.pieces = [m.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(size) if m.is_byte(i)}
        byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        said = [byte_of.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(self.pieces)]
        self.said = [b"" if m.is_control(i) or m.is_unknown(i) else b for i, b in enumerate(said)]
        usual = [i for i in range(size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.scores = [m.get_score(i) for i in range(size)]
        self.score = {self.pieces[i]: (self.scores[i], i) for i in usual}
        self.longest = max(map(len, self.score))
        # The id of every piece, and NO_PIECE for what only begins one.
        self.begins = {p[:k]: NO_PIECE for p in self.score for k in range(1, len(p))} | {p: i for p, (_, i) in self.score.items()}
        self.unknown = min(s for s, _ in self.score.values()) - UNKNOWN_PENALTY
        self.chunk = _chunk_pattern(self.score)
        self.merges = self._by_merges(m)
        self.pairs: dict[int, bool] = {}
        # Answers in use, and those from before.
        self.known: dict[str, tuple[int, ...]] = {}
        self.known_before: dict[str, tuple[int, ...]] = {}
        self._ready = True
        return self

    def text_of(self, part: int) -> str:
        """The piece of an id, or the character of its complement; nothing before the first."""
        return "" if part == NOTHING else self.pieces[part] if part >= 0 else chr(~part)

    def merged(self, text: str) -> list[str]:
        """What is left of a short text after joining, by rank and from the left, adjacent parts that make a piece."""
        score, parts = self.score, list(text)
        ranks = [score.get(a + b, (NO_SCORE,))[0] for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (top := max(ranks)) > NO_SCORE:
            k = ranks.index(top)
            parts[k] += parts.pop(k + 1)
            del ranks[k]
            for near in (k - 1, k):
                if 0 <= near < len(ranks):
                    ranks[near] = score.get(parts[near] + parts[near + 1], (NO_SCORE,))[0]
        return parts

    def beside(self, left: int, right: int) -> bool:
        """Whether merging left and right together leaves the two as they are."""
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        a, b = self.text_of(left), self.text_of(right)
        said = self.pairs[left << 32 | right] = self.merged(a + b) == ([a, b] if a else [b])
        return said

    def _by_merges(self, m) -> bool:
        """Whether ids come from merges by rank (BPE), not from the greatest sum of scores (unigram)."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        said = proto.ModelProto.FromString(self.model)
        kind, piece = said.trainer_spec.model_type, proto.ModelProto.SentencePiece
        if kind not in (proto.TrainerSpec.BPE, proto.TrainerSpec.UNIGRAM):
            raise ValueError(f"models of type {proto.TrainerSpec.ModelType.Name(kind)} are not supported")
        if kind == proto.TrainerSpec.BPE and any(p.type in (piece.USER_DEFINED, piece.UNUSED) for p in said.pieces):
            raise ValueError("BPE models with pieces of the user's own or unused ones are not supported")
        return kind == proto.TrainerSpec.BPE


def _chunk_pattern(pieces: Iterable[str]) -> re.Pattern:
    """What matches one after the other in a marked text are chunks with a boundary of every path between them."""
    after_word: set[str] = set()  # characters that some piece has right after a word character
    for piece in pieces:
        plain = piece.lstrip(MARK)
        if MARK in plain or "\n" in plain:
            return re.compile(r"(?s).+")  # a vocabulary of another kind: the text is one chunk
        after_word |= {b for a, b in zip(plain, plain[1:], strict=False) if re.match(f"[{WORD}]", a)}
    apart = re.escape("".join(c for c in string.punctuation if c not in after_word))
    # Other signs, then a word, up to a sign that begins a piece; what follows any other character stays with it.
    joined = f"(?:[^{WORD}{MARK}\n{apart}][^{MARK}\n]*)?"
    return re.compile(f"{MARK}*(?:[^{WORD}{MARK}\n]*[{WORD}]+{joined}|[^{WORD}{MARK}\n]+)|{MARK}+|\n")


def stream(chars: Iterable[str], v: Vocabulary) -> Iterator[list[int]]:
    """Ids of a stream of characters, in runs: each run is given out once no later character can change it.

    Boundaries are counted from the last one whose path is settled. Of each the lists hold the start of its
    last piece, that piece (the complement of the character where it is spelled in bytes) and, for sums, the
    score up to it. open_at: the boundaries from which the characters so far begin a longer piece; they and
    the newest one are all that a later piece can start at. Paths are compared once the window is two pieces long.
    """
    get, pairs, merges, scores, longest = v.begins.get, v.pairs.get, v.merges, v.scores, v.longest
    starts, last, score = [0], [NOTHING], [0.0]
    window, open_at, look = "", [], 2 * longest

    def path(node: int) -> list[int]:
        ids: list[int] = []
        while node:
            part = last[node]
            if part >= 0:
                ids.append(part)
            else:
                ids += [v.bytes[b] for b in reversed(chr(~part).encode())]
            node = starts[node]
        ids.reverse()
        return ids

    here = 0
    for char in chars:
        window += char
        here += 1
        going, choice, piece = [], -1, 0
        if merges:
            for start in open_at:
                k = get(window[start:])
                if k is not None:
                    going.append(start)
                    if k >= 0 and choice < 0:
                        fits = pairs(last[start] << 32 | k)
                        if v.beside(last[start], k) if fits is None else fits:
                            choice, piece = start, k
            k = get(char)
            if k is not None:
                going.append(here - 1)
            if choice < 0:  # where no longer piece fits, the character is one by itself: some last piece there is
                choice, piece = here - 1, ~ord(char) if k is None or k < 0 else k
        else:
            best = NO_SCORE
            for start in (*open_at, here - 1):
                k = get(window[start:])
                if k is not None:
                    going.append(start)
                    if k >= 0 and score[start] + scores[k] > best:
                        choice, piece, best = start, k, score[start] + scores[k]
            if char not in v.score and score[here - 1] + v.unknown > best:
                choice, piece, best = here - 1, ~ord(char), score[here - 1] + v.unknown
            score.append(best)
        starts.append(choice)
        last.append(piece)
        open_at = going
        if here >= look:
            # Follow the paths back from the boundaries that count, the furthest on first, to where they meet.
            live = {here, *going}
            while len(live) > 1:
                top = max(live)
                live.remove(top)
                live.add(starts[top])
            meet = live.pop()
            if meet:
                yield path(meet)
                starts, last, score = [0, *(n - meet for n in starts[meet + 1 :])], last[meet:], score[meet:]
                window, open_at, here = window[meet:], [n - meet for n in going], here - meet
            look = max(2 * longest, here + longest)
    if len(starts) > 1:
        yield path(len(starts) - 1)


def encode_text(text: str, v: Vocabulary) -> list[int]:
    """Ids of a whole text."""
    if not text:
        return []
    ids: list[int] = []
    known, known_before = v.known, v.known_before
    # Literal space marks are cut out first: they are spelled in bytes and belong to no piece.
    for k, part in enumerate(text.split(MARK)):
        if k:
            ids.extend(v.bytes[b] for b in MARK.encode())
        marked = part.replace(" ", MARK)
        for chunk in v.chunk.findall(MARK + marked if not k else marked):
            got = known.get(chunk)
            if got is None:
                got = known_before.get(chunk)
                if got is None:
                    if len(chunk) > REMEMBERED_LENGTH:
                        for run in stream(chunk, v):
                            ids += run
                        continue
                    got = tuple(i for run in stream(chunk, v) for i in run)
                if len(known) >= REMEMBERED:
                    v.known_before = known_before = known
                    v.known = known = {}
                known[chunk] = got
            ids += got
    return ids


def decode_ids(ids: list[int], v: Vocabulary) -> str:
    text = b"".join([v.said[i] for i in ids]).decode(errors="replace")
    return text[1:] if text.startswith(" ") else text


def _extended(df: DataFrame, field: T.StructField) -> T.StructType:
    return T.StructType([*df.schema.fields, field])


def encode(docs: DataFrame, vocabulary: Vocabulary, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with a column of ids."""
    require(docs, text_col)
    if ids_col in docs.columns:
        raise ValueError(f"docs already has a column {ids_col}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.load()
        for batch in batches:
            for part in text_slices(batch, text_col):
                ids = [None if t is None else encode_text(t, v) for t in part.column(text_col).to_pylist()]
                columns = [*part.columns, pa.array(ids, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, ids_col])

    return docs.mapInArrow(run, _extended(docs, T.StructField(ids_col, T.ArrayType(T.IntegerType()))))


def decode(encoded: DataFrame, vocabulary: Vocabulary, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """encoded with a column of the texts that the ids stand for."""
    require(encoded, ids_col)
    if text_col in encoded.columns:
        raise ValueError(f"the table already has a column {text_col}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.load()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if ids is None else decode_ids(ids, v) for ids in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, text_col])

    return encoded.mapInArrow(run, _extended(encoded, T.StructField(text_col, T.StringType())))


def encode_and_verify(docs: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, n_tokens and whether decoding gives the text back; null texts: null, 0, true."""
    require(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.load()
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = part.column("text").to_pylist()
                ids = [None if t is None else encode_text(t, v) for t in texts]
                same = [i is None or decode_ids(i, v) == t for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.list_(pa.int32())), pa.array(same)], names=["id", "ids", "round_trip"])

    id_type = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {id_type}, ids array<int>, round_trip boolean")
    return out.select(F.col("id").alias(id_col), "ids", F.coalesce(F.size(F.when(F.col("ids").isNotNull(), F.col("ids"))), F.lit(0)).cast("long").alias("n_tokens"), "round_trip")
