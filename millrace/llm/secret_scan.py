"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

Ordinary words and names pack several characters into a token of a large BPE vocabulary; random keys do
not. A run of 16 key characters or more with few characters per token is reported as kind `dense`, unless
it is a digest of a known length, a UUID, or an identifier made of words. Whether the letter parts of an
identifier are words is told by their tokens as well: each is one token or has enough characters per
token. Runs of letters alone under 20 characters may be rare words, so they must be denser still. The
patterns are leftmost and non-overlapping for each kind; spans are code points, end exclusive.

Defined results: null and empty texts have no spans (the digest is that of the empty string); repeated
rows give repeated results; a text of any length is scanned whole, and a run of any length is one span;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import require, text_or_empty, text_slices

KINDS = ("assign", "access", "hex", "dense")

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A run of these characters is maximal, so asking for the least length at once finds the same spans.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Letters alone under SHORT characters need so many characters per token less.
SHORT, SHORT_MARGIN = 20, 0.2

DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
HEX_ONLY = re.compile(r"[0-9a-fA-F]+\Z")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
#: Words joined by separators, each with a short number at most: names of files, functions, versions.
IDENTIFIER = re.compile(r"[+/_=-]*(?:[A-Za-z]+[0-9]{0,4}(?:[+/_=-]+|\Z)|[0-9]{1,4}(?:[+/_=-]+|\Z))+\Z")

LETTERS = re.compile(r"[A-Za-z]+")


class TokenEfficiency:
    """Characters per token of a string under a tiktoken vocabulary; loads once a worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self._encoding = ranks, pattern, None

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern, "_encoding": None}

    def __call__(self, text: str) -> float:
        if self._encoding is None:
            import tiktoken

            self._encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return len(text) / max(1, len(self._encoding.encode_ordinary(text)))


def is_known(run: str) -> bool:
    return bool(HEX_ONLY.match(run) and len(run) in DIGEST_LENGTHS or UUID.match(run))


def is_known_or_identifier(run: str) -> bool:
    """By shape alone."""
    return is_known(run) or bool(IDENTIFIER.match(run))


def is_made_of_words(run: str, efficiency, most: float) -> bool:
    """Shaped like an identifier, with letter parts of one token or of enough characters per token."""
    return bool(IDENTIFIER.match(run)) and all((e := efficiency(part)) >= most or e == len(part) for part in LETTERS.findall(run))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = []
    # Each pattern needs one of these characters or strings: most texts hold none and are left at once.
    if ":" in text or "=" in text:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def dense_spans(text: str, efficiency, most: float) -> list[tuple[int, int, str]]:
    found = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        # Without a letter, or of one character only, a run is a rule or a number.
        if not LETTERS.search(run) or len(set(run)) == 1 or is_known(run):
            continue
        least = most - SHORT_MARGIN if len(run) < SHORT and run.isalpha() else most
        if efficiency(run) < least and not is_made_of_words(run, efficiency, least):
            found.append((m.start(), m.end(), "dense"))
    return found


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered(spans))


SPAN = "struct<kind:string,start:int,end:int,value:string>"


def find_secrets(
    docs: DataFrame,
    efficiency: TokenEfficiency,
    *,
    most_chars_per_token: float = 2.2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: id and its spans (kind, start, end, value) by start, then kind."""
    require(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    id_type = rows.schema["id"].dataType.simpleString()
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "body"):
                out = []
                for text in part.column("body").to_pylist():
                    spans = ordered(base_spans(text) + dense_spans(text, efficiency, most_chars_per_token))
                    out.append([{"kind": k, "start": s, "end": e, "value": text[s:e]} for s, e, k in spans])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out, pa.list_(kind))], names=["id", "spans"])

    return rows.mapInArrow(scan, f"id {id_type}, spans array<{SPAN}>").withColumnRenamed("id", id_col)


def report(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of what find_secrets() gives; made by Spark's own functions."""

    def said(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "dense")
    return found.select(
        id_col,
        number("assign"),
        number("access"),
        number("hex"),
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
        number("dense"),
    )


def base_sha256(text: str) -> str:
    return hashlib.sha256(joined(base_spans(text)).encode()).hexdigest()
