"""Language identification: words first, then shorter and shorter character n-grams.

A known word counts with its log frequency in each language. An unseen word is read as character
4-grams of "<word>"; a gram that no language knows gives way to the shorter gram with the same end, down
to single characters. A text's score for a language is the sum over its words; the reported score is the
posterior of the best language with the evidence held to EVIDENCE words, so that it stays graded for
long texts. Ties go to the language that sorts first.

Training counts every word and n-gram of a sample of the labelled texts: all of them where they are no
more than about `most_rows` different texts with `most_chars` characters together, else those with the
least hashes. These two are the only bounds; nothing that the sample holds is left out. Equal texts of one
language count once. Prediction reads every word of every text.

Defined results: null texts and texts without a letter give "und" and score 0, as does everything where
no row could be learned from. Rows with a null language are not learned from. A text of any length is
scored whole, a part at a time. Repeated rows give repeated results; an empty table gives an empty result;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import require, text_slices

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ASCII_WORD, OUTSIDE_PLANE = re.compile("[a-z]+"), re.compile("[\U00010000-\U0010ffff]")
LONGEST_GRAM = 4
#: Weight, in words, of the mean of all languages.
SMOOTHING = 100.0
EVIDENCE = 20
#: Unseen words remembered by a worker.
REMEMBERED = 1 << 17
#: Words of a text summed at a time.
PART = 10_000
UNKNOWN = "und"


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@cache
def _plane_word() -> re.Pattern:
    """WORD for texts within the basic plane, in the form that Python's own engine looks up in a table."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(1 << 16)]

    def members(which: str) -> str:
        inside = np.array([k in which for k in kinds])
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))

    return re.compile(f"[{members('L')}][{members('LM')}]*")


def words_of(text: str) -> list[str]:
    """Words in small letters."""
    text = text.lower()
    if text.isascii():
        return ASCII_WORD.findall(text)
    return (WORD if OUTSIDE_PLANE.search(text) else _plane_word()).findall(text)


class Model:
    """Log frequencies by language of words and of n-grams; rows of a matrix."""

    def __init__(self, languages: list[str], words: dict[str, int], by_length: list[dict[str, int]], matrix: np.ndarray):
        self.languages, self.words, self.by_length, self.matrix = languages, words, by_length, matrix

    @classmethod
    def of_counts(cls, languages: list[str], words: dict[tuple[str, str], int], by_length: list[dict[tuple[str, str], int]]) -> Model:
        """Of counts by (language, word) and, for each length, by (language, n-gram)."""
        tables = [([k[0] for k in t], [k[1] for k in t], list(t.values())) for t in (words, *by_length)]
        return cls.of_columns(languages, tables)

    @classmethod
    def of_columns(cls, languages: list[str], tables: list[tuple]) -> Model:
        """Of tables (languages, keys, counts): the first of words, then of n-grams by length."""
        column, found, rows, begin = {name: j for j, name in enumerate(languages)}, [], [], 0
        for names, keys, counts in tables:
            known = sorted(set(keys))
            place = {k: i for i, k in enumerate(known)}
            table = np.zeros((len(known), len(languages)))
            if known:
                table[[place[k] for k in keys], [column[n] for n in names]] = counts
                # Smoothed towards the mean of all languages, so that one with few words does not draw rare ones to itself.
                total = table.sum(axis=0)
                everywhere = (table / np.maximum(total, 1)).mean(axis=1, keepdims=True)
                table = np.log(table + SMOOTHING * everywhere) - np.log(total + SMOOTHING)
            found.append({k: begin + i for k, i in place.items()})
            rows.append(table)
            begin += len(known)
        return cls(languages, found[0], found[1:], np.concatenate(rows))

    def unseen(self, word: str) -> np.ndarray:
        """The score of a word that is not known: a sum over its characters."""
        padded = f"<{word}>"
        found = []
        for end in range(1, len(padded) + 1):
            for n in range(min(LONGEST_GRAM, end), 0, -1):
                row = self.by_length[n - 1].get(padded[end - n : end])
                if row is not None:
                    found.append(row)
                    break
        # Neighbouring grams overlap: dividing by their length leaves about one count a character.
        return self.matrix[found].sum(axis=0) / LONGEST_GRAM if found else np.zeros(len(self.languages))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.room = np.empty((len(model.words) + REMEMBERED, len(model.languages)))
        self.room[: len(model.words)] = model.matrix[: len(model.words)]
        self.place = dict(model.words)

    def _learn(self, word: str) -> int:
        row = self.place.get(word)
        if row is None:
            row = len(self.place)
            self.room[row] = self.model.unseen(word)
            self.place[word] = row
        return row

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.model.languages))
        for at in range(0, len(words), PART):
            part = words[at : at + PART]
            if len(self.place) + len(part) > len(self.room):
                self.place = dict(self.model.words)
            rows = list(map(self.place.get, part))
            if None in rows:
                rows = [self._learn(w) if r is None else r for w, r in zip(part, rows, strict=True)]
            total += self.room[rows].sum(axis=0)
        best = int(np.argmax(total))
        tempered = (total - total[best]) * min(1.0, EVIDENCE / len(words))
        return self.model.languages[best], 1.0 / math.fsum(np.exp(tempered).tolist())


def _word_counts(rows: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                seen: Counter = Counter()
                for language, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    seen.update((language, w) for w in words_of(text))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"]
                )

    return rows.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _gram_counts(words: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for language, word, times in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                for size in range(1, LONGEST_GRAM + 1):
                    for gram in grams(word, size):
                        seen[language, size, gram] += times
            keys = list(seen)
            columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(seen.values()), pa.int64())], names=["lang", "size", "gram", "n"])

    return words.mapInArrow(count, "lang string, size int, gram string, n bigint").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def _sample(rows: DataFrame, most_rows: int, most_chars: int) -> DataFrame:
    """Different (lang, text) rows, about so many at most; a text that many rows hold is one, whatever their ids."""
    rows = rows.withColumn("h", F.xxhash64("lang", "text"))
    there = rows.agg(F.approx_count_distinct("h", 0.01).alias("texts"), F.sum(F.length("text").cast("double")).alias("chars"), F.count(F.lit(1)).alias("rows")).first()
    # Copies are counted among the characters, which only makes the sample smaller.
    share = min(1.0, most_rows / max(1, there["texts"]), most_chars / max(1.0, there["chars"] or 0.0)) if there["rows"] > most_rows or (there["chars"] or 0) > most_chars else 1.0
    if share < 1:
        rows = rows.filter(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40)))
    return rows.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def train(
    docs: DataFrame,
    learn_from: Column | None = None,
    *,
    most_rows: int = 20_000,
    most_chars: int = 100_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """Learn from rows of docs for which learn_from holds and whose text and language are known."""
    require(docs, id_col, text_col, lang_col)
    rows = docs if learn_from is None else docs.filter(learn_from)
    rows = rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sample = _sample(rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")), most_rows, most_chars)
    # Two reads of a bounded table follow: the counts of the sample's words.
    words = _word_counts(sample).persist()
    try:
        of_words = words.select("lang", "word", "n").toArrow()
        of_grams = _gram_counts(words).select("size", "lang", "gram", "n").toArrow()
    finally:
        words.unpersist()
    tables = [tuple(c.to_pylist() for c in of_words.columns)]
    size = of_grams.column("size").to_numpy()
    for length in range(1, LONGEST_GRAM + 1):
        tables.append(tuple(c.to_pylist() for c in of_grams.filter(pa.array(size == length)).columns[1:]))
    return Model.of_columns(sorted(set(tables[0][0])), tables)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the predicted language and its score; only the text is read."""
    require(docs, text_col)
    for c in (pred_col, score_col):
        if c in docs.columns:
            raise ValueError(f"docs already has a column {c}")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            for part in text_slices(batch, text_col):
                said = [score(t) for t in part.column(text_col).to_pylist()]
                columns = [*part.columns, pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, pred_col, score_col])

    schema = docs.select("*", F.lit("").alias(pred_col), F.lit(0.0).alias(score_col)).schema
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """id, held_out, lang_pred, score: learned from the rows that are not held out, predicted for all."""
    model = train(docs, ~held_out(id_col), id_col=id_col, text_col=text_col, lang_col=lang_col, **bounds)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("__text"))
    return predict(rows, model, text_col="__text").select(id_col, "held_out", "lang_pred", "score")
