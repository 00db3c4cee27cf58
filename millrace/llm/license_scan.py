"""Licence scan by canonical digests.

A text is brought to a canonical form: lower case, equivalent spellings made one, copyright lines left
out, punctuation and white space made single spaces. The digests of entire texts are then joined with
the digests of known licences, which go through the same form. Besides whole documents, each line of a
document is looked up as a text of its own, since notices stand on lines of their own.

Defined results: null and empty texts, and texts of which nothing is left, match nothing. Repeated rows
give repeated results; an empty table, of either kind, gives no matches; two licences with the same form
are told by the one whose name sorts first; a text of any length is read whole, in time that grows with its
length; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import require, text_or_empty, text_slices

# Spellings that licence texts use for one another.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("and or", "or"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("wilful", "willful"),
    ("fulfil", "fulfill"),
    ("https", "http"),
    ("v", "version"),
    ("cc", "creative commons"),
    ("by nc", "attribution noncommercial"),
    ("gpl", "gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
]

# Public licence texts and the notices that stand for a licence.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
]

#: Whole licence texts as published, one a file: its name, and after a plus sign which wording it is.
TEXTS = Path(__file__).parent / "licenses"
#: Titles that stand above the texts of licences without one of their own.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def whole_licenses() -> list[tuple[str, str]]:
    """license, text: whole texts in the forms they are handed on: with a title, without list numbers, without the appendix."""
    texts = [(f.stem.split("+")[0], f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))]
    texts += [(name, text) for name, text in KNOWN if name in TITLES and len(text) > 500]
    found = []
    for name, text in texts:
        forms = [text]
        if END_OF_TERMS in text:
            forms.append(text[: text.index(END_OF_TERMS)] + END_OF_TERMS)
            forms.append(text[: text.index(END_OF_TERMS)])
        if name in TITLES:
            forms.append(re.sub(r"(?m)^ *[0-9]\. ", "* ", text))
            forms += [f"{title}\n\n{form}" for title in TITLES[name] for form in forms[:]]
        found += [(name, form) for form in forms]
    return found


#: A line that names who holds the rights and when: "Copyright (c) 2020 …", "© …", "All rights reserved".
#: It never runs over a line's end, so it costs no more than the text is long.
COPYRIGHT_LINE = r"(?m)^[^\w\n]*(copyright\b.*\b[0-9]{4}\b.*|copyright \(c\).*|©.*|\(c\) *[0-9]{4}.*|all rights reserved[^\w\n]*)$"


_SPACED = {c: " " for c in (*range(0x2E), 0x2F, *range(0x3A, 0x61), *range(0x7B, 0x80), *range(0x2010, 0x2020)) if c != 0x0A}
_COPYRIGHT = re.compile(COPYRIGHT_LINE, re.ASCII)
_FULL_STOP = re.compile(r"\.([^0-9]|$)")
_WORDINGS = [(f" {spelling.replace(' ', '  ')} ", f" {usual.replace(' ', '  ')} ") for spelling, usual in SPELLINGS]


def _bare(text: str) -> str:
    """Lower case, without copyright lines and punctuation; line ends stay."""
    text = text.lower()
    if "copyright" in text or "rights" in text or "\u00a9" in text or "(c)" in text:
        text = _COPYRIGHT.sub(" ", text)
    text = text.translate(_SPACED)
    # A full stop before a digit is part of a version; any other is punctuation.
    return _FULL_STOP.sub(r" \1", text) if "." in text else text


def _worded(bare: str) -> str:
    words = [w for w in bare.split(" ") if w]
    form = f" {'  '.join(words)} "
    for spelling, usual in _WORDINGS:
        if spelling in form:
            form = form.replace(spelling, usual)
    return " ".join(w for w in form.split(" ") if w)


def canonical(text: str | None) -> str:
    return _worded(_bare(text or "").replace("\n", " "))


def _hashed(form: str) -> bytes | None:
    return hashlib.sha256(form.encode()).digest() if form else None


def digest(text: str | None) -> bytes | None:
    return _hashed(canonical(text))


def _digests(text: str) -> list[bytes | None]:
    """Of the whole text, then of each line of which something is left."""
    bare = _bare(text)
    lines = (_worded(line) for line in bare.split("\n"))
    return [_hashed(_worded(bare.replace("\n", " "))), *(_hashed(form) for form in lines if form)]


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """license, digest; by default of KNOWN and of the whole texts."""
    texts = [*KNOWN, *whole_licenses()] if texts is None else texts
    return known_of(spark.createDataFrame(texts, "license string, text string"))


def known_of(table: DataFrame, name_col: str = "license", text_col: str = "text") -> DataFrame:
    """license, digest of a table of names and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("license"), pa.array([digest(t) for t in batch.column("text").to_pylist()], pa.binary())], names=["license", "digest"])

    named = table.select(F.col(name_col).cast("string").alias("license"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "license string, digest binary")


def canonical_sql(text: str) -> str:
    """The same as canonical(), as SQL of an engine whose regexp_replace takes the flag 'g'."""
    form = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', ' ', 'g')"
    form = f"regexp_replace({form}, '[\\x00-\\x2D\\x2F\\x3A-\\x60\\x7B-\\x7F\\x{{2010}}-\\x{{201F}}]+', ' ', 'g')"
    form = f"regexp_replace({form}, '\\.([^0-9]|$)', ' \\1', 'g')"
    form = f"' ' || replace(trim(regexp_replace({form}, ' +', ' ', 'g')), ' ', '  ') || ' '"
    for spelling, usual in SPELLINGS:
        form = f"replace({form}, ' {spelling.replace(' ', '  ')} ', ' {usual.replace(' ', '  ')} ')"
    return f"trim(regexp_replace({form}, ' +', ' ', 'g'))"


def known_sql() -> str:
    """The known licences as rows of SQL: license, text."""
    return ", ".join("({}, {})".format(*("'" + v.replace("'", "''") + "'" for v in row)) for row in [*KNOWN, *whole_licenses()])


def scan(docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, license of the whole text, licenses of its lines (sorted), number of such lines.

    Each text is read once: its digest and those of its lines are joined with known (Spark chooses how),
    and what matched is gathered by id and content. Rows with one id and text are counted and told again.
    """
    require(docs, id_col, text_col)
    known = known.filter("digest is not null").groupBy("digest").agg(F.min("license").alias("license"))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    id_type = rows.schema["id"].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "body"):
                texts = part.column("body").to_pylist()
                columns = [
                    part.column("id"),
                    pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary()),
                    pa.array([_digests(t) for t in texts], pa.list_(pa.binary())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "content", "digests"])

    told = rows.mapInArrow(digests, f"id {id_type}, content binary, digests array<binary>")
    told = told.select("id", "content", F.posexplode("digests").alias("at", "digest"))
    whole, named = F.col("at") == 0, F.col("license").isNotNull()
    found = told.join(known, "digest", "left").filter(whole | named)
    said = found.groupBy("id", "content").agg(
        F.count_if(whole).alias("copies"),
        F.max(F.when(whole, F.col("license"))).alias("license"),
        F.array_join(F.sort_array(F.collect_set(F.when(~whole, F.col("license")))), ",").alias("line_licenses"),
        F.count_if(~whole).alias("n"),
    )
    # Copies of a row have the same lines.
    n = (F.col("n") / F.col("copies")).cast("long").alias("n_license_lines")
    return said.select(F.col("id").alias(id_col), "license", "line_licenses", n, F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")
