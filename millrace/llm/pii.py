"""Personal data in texts, with DataFrame functions only.

1. Regular expressions propose spans. The text between two proposals and the proposals themselves give the
   places, in characters (split() and regexp_extract_all() see the same matches).
2. Validators confirm: numbers of an address, Luhn's sum, mod 97, numbers of digits.
3. The words before a span, at most CONTEXT characters and not past the proposal before it, move its score
   (per cent) up or down. Kinds that stand on their own are always told; the others from LEAST on.

Each pattern is read once from left to right: possessive runs and looks at the character before keep it from
starting again inside a run, so the time grows with the text. Places are added up in stretches of STRETCH
proposals.

Kinds: email, ip, card (16 to 19 digits), phone (with a country's code) stand on their own. iban needs mod 97.
ssn, localphone (ten digits in three groups) and shortcard (13 to 15 digits that pass Luhn) need a word near
them.

Defined results: null counts as empty and has no spans. A text of any length is read whole. Repeated rows give
repeated results; rows with a null id are read like others; an empty table gives an empty result. Extra columns
are ignored by find_personal_data() and pass through redact(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import require, text_or_empty

CONTEXT, LEAST, STRETCH = 40, 50, 64


def _count(text: Column, low: int, high: int) -> Column:
    n = F.length(F.regexp_replace(text, "[^0-9]", ""))
    return n.between(low, high)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once: what stands inside a lambda is worked out for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def luhn(text: Column) -> Column:
    """Whether the digits of text, separators left out, pass Luhn's sum."""

    def passes(digits: Column) -> Column:
        n = F.length(digits)

        def add(total: Column, i: Column) -> Column:
            d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
            doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
            return total + F.when((n - i) % 2 == 1, doubled).otherwise(d)

        return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0)

    return _let(F.regexp_replace(text, "[^0-9]", ""), passes)


def mod97(text: Column) -> Column:
    """Whether an account number, spaces left out, has 15 to 34 signs and leaves 1 modulo 97."""
    bare = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substring(bare, 5, 1 << 20), F.substring(bare, 1, 4))

    def step(rest: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.length(bare).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)


@dataclass(frozen=True)
class Kind:
    """near and against: words, as alternatives of a pattern, that move the score by `near_adds` and -`against_takes`."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: int
    near: str
    near_adds: int
    alone: bool = True
    against: str = ""
    against_takes: int = 0
    holds: str = ""
    #: What the text before the span must not end with.
    not_after: str = ""

    @property
    def least(self) -> int:
        return 0 if self.alone else LEAST


_BOUND_L, _BOUND_R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_CARD = r"[0-9](?:[\x20-]?+[0-9])++"
KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.lit(True), 90, "e-?mail|contact|write", 10, holds="@"),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda t: t.rlike(r"^(?:(?:^|\.)0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?=\.|$)){4}$"),
        60,
        "ip|address|host|server|login",
        30,
        against="version|release|build|section",
        against_takes=40,
        holds=".",
    ),
    Kind("card", _CARD, lambda t: _count(t, 16, 19) & luhn(t), 80, "card|visa|credit|payment", 20, against="order|invoice|tracking|serial", against_takes=30),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: _count(t, 8, 15), 60, "phone|tel|call|mobile|fax|cell", 30, holds="+"),
    Kind("iban", _BOUND_L + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _BOUND_R, mod97, 80, "iban|account|bank", 20),
    Kind("ssn", _BOUND_L + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _BOUND_R, lambda t: ~t.rlike("^(000|666|9)|-00-|-0000$"), 30, "ssn|social security", 50, alone=False, holds="-"),
    Kind(
        "localphone",
        _BOUND_L + r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}" + _BOUND_R,
        lambda t: F.lit(True),
        30,
        "phone|tel|call|mobile|fax|cell",
        40,
        alone=False,
        not_after=r"\+[0-9 ().-]*$",
    ),
    Kind("shortcard", _CARD, lambda t: _count(t, 13, 15) & luhn(t), 40, "card|visa|credit|payment|amex", 30, alone=False),
]
BASE = ["email", "ip", "card", "phone"]


def _sums(sizes: Column) -> Column:
    """Of each element of an array of numbers, the sum of those before it, in stretches."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def before(part: Column) -> Column:
        return F.transform(part, lambda x, i: total(F.slice(part, F.lit(1), i)))

    def stretches(all_sizes: Column) -> Column:
        last = F.floor((F.greatest(F.size(all_sizes), F.lit(1)) - 1) / STRETCH).cast("int")
        own = lambda k: _let(F.slice(all_sizes, k * STRETCH + 1, F.lit(STRETCH)), lambda s: F.struct(before(s).alias("own"), total(s).alias("sum")))
        return F.transform(F.sequence(F.lit(0), last), own)

    def shifted(parts: Column) -> Column:
        moved = _let(F.transform(parts, lambda p: p["sum"]), before)
        return F.flatten(F.zip_with(parts, moved, lambda p, by: F.transform(p["own"], lambda x: x + by)))

    return _let(sizes, lambda z: _let(stretches(z), shifted))


def _gaps(body: Column, kind: Kind) -> Column:
    """The texts before, between and after the proposals."""
    return F.split(body, kind.pattern, -1)


def _proposals(body: Column, kind: Kind) -> Column:
    return F.regexp_extract_all(body, F.lit(kind.pattern), F.lit(0))


def _tail(text: Column) -> Column:
    return F.lower(F.substring(text, -CONTEXT, CONTEXT))


def _score(kind: Kind, before: Column) -> Column:
    score = F.lit(kind.score) + F.when(before.rlike(kind.near), kind.near_adds).otherwise(0)
    if kind.against:
        score = score - F.when(before.rlike(kind.against), kind.against_takes).otherwise(0)
    return F.least(score, F.lit(100)).cast("int")


def _confirmed(kind: Kind, text: Column, before: Column) -> Column:
    ok = kind.valid(text) & (_score(kind, before) >= kind.least)
    return ok & ~before.rlike(kind.not_after) if kind.not_after else ok


def _with_spans(rows: DataFrame, body: str, kind: Kind, out: str) -> DataFrame:
    """rows with an array of (kind, start, end, score) in order of place."""
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:int>>)")
    text, at, found, starts = F.col(body), f"{out}_at", f"{out}_found", f"{out}_starts"
    gaps = F.transform(_gaps(text, kind), lambda g: F.struct(F.length(g).alias("n"), _tail(g).alias("before")))
    some = text.contains(kind.holds) if kind.holds else F.lit(True)
    rows = rows.withColumns({found: F.when(some, _proposals(text, kind))})
    rows = rows.withColumns({at: F.when(F.size(found) > 0, gaps)})
    # All arrays are arguments here, never read inside a lambda, where they would be worked out for each element.
    sizes = F.zip_with(F.slice(at, 1, F.size(found)), F.col(found), lambda g, m: g["n"] + F.length(m))
    rows = rows.withColumns({starts: F.when(F.size(found) > 0, _sums(sizes))})
    placed = F.zip_with(F.slice(at, 1, F.size(found)), F.col(starts), lambda g, s: F.struct(g["before"].alias("before"), (s + g["n"]).alias("start")))
    each = F.zip_with(F.col(found), placed, lambda m, x: F.struct(m.alias("m"), x["before"].alias("before"), x["start"].alias("start")))
    kept = F.filter(each, lambda x: _confirmed(kind, x["m"], x["before"]))
    spans = F.transform(
        kept,
        lambda x: F.struct(F.lit(kind.name).alias("kind"), x["start"].cast("int").alias("start"), (x["start"] + F.length(x["m"])).cast("int").alias("end"), _score(kind, x["before"]).alias("score")),
    )
    return rows.withColumn(out, F.when(F.size(found) > 0, spans).otherwise(none)).drop(at, found, starts)


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", kinds: list[Kind] | None = None) -> DataFrame:
    """id, spans: array of (kind, start, end, score) of each row, by kind as listed and then by place."""
    require(docs, id_col, text_col)
    kinds = KINDS if kinds is None else kinds
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    for i, kind in enumerate(kinds):
        rows = _with_spans(rows, "body", kind, f"spans{i}")
    return rows.select(F.col("id").alias(id_col), F.concat(*[F.col(f"spans{i}") for i in range(len(kinds))]).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(spans: str, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def report(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id, a count of each base kind, base_sha256 and spans as strings, and the spans' scores (per cent)."""
    counts = [F.size(_of("spans", [k])).cast("long").alias(f"n_{k}") for k in BASE]
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return found.select(id_col, *counts, F.sha2(_joined(_of("spans", BASE)), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), scores.alias("scores"))


def _masked(kind: Kind, gaps: str, found: str) -> Column:
    def one(gap: Column, m: Column) -> Column:
        return F.concat(gap, F.when(_confirmed(kind, m, _tail(gap)), f"[{kind.name.upper()}]").otherwise(m))

    return F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(found)), F.col(found), one), ""), F.element_at(gaps, -1))


def redact(docs: DataFrame, *, text_col: str = "text", kinds: list[Kind] | None = None) -> DataFrame:
    """docs with every span in the text written as its kind in brackets, such as [EMAIL]; null stays null.

    Kind after kind, so that a span which lies in one that is gone already is gone with it.
    """
    require(docs, text_col)
    names = set(docs.columns)
    body, gaps, found = (next(n for k in range(len(names) + 1) if (n := f"__{w}{k}") not in names) for w in ("body", "gaps", "found"))
    rows = docs.withColumn(body, F.col(text_col).cast("string"))
    for kind in KINDS if kinds is None else kinds:
        rows = rows.withColumns({gaps: _gaps(F.col(body), kind), found: _proposals(F.col(body), kind)})
        rows = rows.withColumn(body, F.when(F.size(found) > 0, _masked(kind, gaps, found)).otherwise(F.col(body))).drop(gaps, found)
    return rows.select(*[F.col(body).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
