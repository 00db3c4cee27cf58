"""Scalar column functions: guards, canonical text and digests, schedules, redaction, clocks."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(x: Column) -> Column:
    """True for a number; false for null, NaN and infinities."""
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def clip(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def floored_ratio(top: Column, bottom: Column, floor: float) -> Column:
    return top / F.greatest(bottom, F.lit(floor))


def percent_error(left: Column, right: Column, scale: Column, floor: float = 0.1) -> Column:
    """100 * |left - right| / max(|scale|, floor); null unless all three are finite."""
    return F.when(finite(left) & finite(right) & finite(scale), floored_ratio(100 * F.abs(left - right), F.abs(scale), floor))


def affine(unit: Column, low, high) -> Column:
    return F.lit(low) + unit * (F.lit(high) - F.lit(low))


def to_unit_range(x: Column, low, high) -> Column:
    """[low, high] -> [-1, 1]."""
    return 2 * (x - F.lit(low)) / (F.lit(high) - F.lit(low)) - 1


def canonical_json(*columns: str) -> Column:
    """JSON of the columns with sorted keys and no spaces; for integers, strings and booleans, whose text is the same everywhere."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def _let(value: Column, f) -> Column:
    """f(value) with the value worked out once."""
    return F.transform(F.array(value), lambda v: f(v))[0]


def _read_digits(size: Column) -> Column:
    plain = size.cast("string")
    whole, part = F.regexp_extract(plain, r"^([0-9]+)\.", 1), F.regexp_extract(plain, r"\.([0-9]+)", 1)
    shift = F.coalesce(F.regexp_extract(plain, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    power = shift + F.when(whole == "0", -F.length(F.regexp_extract(part, "^(0*)", 1)) - 1).otherwise(F.length(whole) - 1)
    digits = F.regexp_replace(F.regexp_replace(F.concat(whole, part), "^0+(?=.)", ""), "(?<=.)0+$", "")
    return F.struct(size.alias("size"), digits.alias("digits"), power.alias("power"))


def _shorter(v: Column) -> Column:
    """One digit less, where that still reads back as the number."""
    rounded = F.floor((v["digits"].try_cast("decimal(20,0)") + 5) / 10).cast("decimal(20,0)").cast("string")

    def kept(r: Column) -> Column:
        power = F.when(F.length(r) >= F.length(v["digits"]), v["power"] + 1).otherwise(v["power"])
        said = F.concat(F.substring(r, 1, 1), F.lit("."), F.substr(r, F.lit(2)), F.lit("0E"), power.cast("string"))
        good = (F.length(v["digits"]) > 1) & (said.try_cast("double") == v["size"])
        shorter = F.struct(v["size"].alias("size"), F.regexp_replace(r, "(?<=.)0+$", "").alias("digits"), power.alias("power"))
        return F.when(F.coalesce(good, F.lit(False)), shorter).otherwise(v)

    return _let(rounded, kept)


def _written(v: Column) -> Column:
    digits, power = v["digits"], v["power"]
    after, rest = F.substr(digits, power + 2), F.substr(digits, F.lit(2))
    large = F.concat(F.substr(F.rpad(digits, 17, "0"), F.lit(1), power + 1), F.lit("."), F.when(after == "", "0").otherwise(after))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-power - 1, F.lit(0))), digits)
    exponent = F.abs(power).cast("string")
    exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.when(F.length(exponent) < 2, F.concat(F.lit("0"), exponent)).otherwise(exponent))
    scientific = F.concat(F.substring(digits, 1, 1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"), exponent)
    return F.when(v["size"] == 0, "0.0").when(power.between(0, 15), large).when(power.between(-4, -1), small).otherwise(scientific)


def canonical_number(x: Column) -> Column:
    """The shortest text of a double that reads back as it, as JSON has it; minus zero is zero. Fails on what is not finite.

    The engine's own text may have a digit too many, and turns to exponents at other places.
    """
    number = x.cast("double") + 0.0
    text = _let(_let(_let(_let(F.abs(number), _read_digits), _shorter), _shorter), _written)
    signed = F.concat(F.when(number < 0, "-").otherwise(""), text)
    return F.when(number.isNull(), F.lit(None)).when(finite(number), signed).otherwise(F.raise_error(F.lit("a number is not finite")).cast("string"))


def canonical_text(x: Column) -> Column:
    """A string as JSON."""
    said = F.to_json(F.array(x))
    return F.when(x.isNotNull(), F.substr(said, F.lit(2), F.length(said) - 2))


def canonical_time(ts: Column) -> Column:
    return canonical_text(utc_text(ts))


def canonical_object(fields: Mapping[str, Column]) -> Column:
    """A JSON object of values that are JSON already (canonical_*, other objects, integers as text): sorted keys, no spaces, nulls kept."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(fields[k].cast("string"), F.lit("null"))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def canonical_value(x: Column, kind: T.DataType) -> Column:
    """Any value as JSON, by recursion over its type: sorted keys, no spaces, nulls kept, minus zero as zero.

    Times are texts in UTC, dates and decimals their own texts, bytes base64. Keys of maps must be strings. Fails on
    a number that is not finite.
    """
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), canonical_value(x.getField(f.name), f.dataType)) for f in fields]
        said = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        said = F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: canonical_value(e, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise TypeError("keys of maps must be strings")
        # The value goes through the lambda with its key: entries are sorted by key, which no two share.
        order = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
        one = lambda e: F.concat(canonical_text(e["key"]), F.lit(":"), canonical_value(e["value"], kind.valueType))
        said = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(x), order), one), ","), F.lit("}"))
    elif isinstance(kind, T.BooleanType):
        said = F.when(x, "true").otherwise("false")
    elif isinstance(kind, T.DoubleType | T.FloatType):
        said = canonical_number(x)
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        said = canonical_time(x.cast("timestamp"))
    elif isinstance(kind, T.BinaryType):
        said = canonical_text(F.base64(x))
    elif isinstance(kind, T.IntegralType):
        said = x.cast("string")
    elif isinstance(kind, T.StringType | T.DateType | T.DecimalType):
        said = canonical_text(x.cast("string"))
    else:
        raise TypeError(f"no canonical form of {kind.simpleString()}")
    return F.coalesce(F.when(x.isNotNull(), said), F.lit("null"))


def canonical_row(schema: T.StructType) -> Column:
    """A row of this schema as a JSON object."""
    return canonical_value(F.struct(*[F.col(f"`{n}`") for n in schema.fieldNames()]), schema)


def content_id(text: Column, digits: int = 20) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def hash_rank(salt: str, *keys: Column) -> Column:
    """A digest to order by: the same rows in the same order on any engine."""
    return F.sha2(F.concat_ws("|", F.lit(salt), *[k.cast("string") for k in keys]), 256)


def seed_of(text: Column) -> Column:
    """The first four bytes of the digest, as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def hmac_sha256(key: bytes, text: Column) -> Column:
    """Hex of the keyed digest; the key is a constant of the plan."""
    if len(key) > 64:
        raise ValueError("keys have 64 bytes at most")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key.ljust(64, b"\0")).hex())) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))
    return F.sha2(F.concat(outer, first), 256)


def address_number(text: Column) -> Column:
    """An IPv4 address, also one written as ::ffff:a.b.c.d, as a number; null for anything else."""
    plain = F.regexp_replace(F.lower(F.trim(text)), "^::ffff:", "")
    parts = F.split(plain, r"\.")
    good = plain.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$")
    number = parts[0].try_cast("long")
    for i in (1, 2, 3):
        number = number * 256 + F.try_element_at(parts, F.lit(i + 1)).try_cast("long")
    return F.when(good, number)


def in_network(text: Column, network: str) -> Column:
    """Whether an IPv4 address lies in a network such as 10.0.0.0/8; false for what is none."""
    base, bits = network.split("/")
    start = 0
    for part in base.split("."):
        start = start * 256 + int(part)
    size = 1 << (32 - int(bits))
    return F.coalesce(F.floor(address_number(text) / size) == start // size, F.lit(False))


def time_ordered_id(ts: Column, entropy: Column) -> Column:
    """A version 7 UUID: the milliseconds of ts, then bits of the entropy's digest; ids sort by time."""
    digest = F.sha2(entropy, 256)
    head = F.lpad(F.lower(F.hex(F.unix_millis(ts))), 12, "0")
    variant = F.substr(F.lit("89ab"), F.pmod(F.conv(F.substring(digest, 4, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(head, 1, 8), F.substring(head, 9, 4), F.concat(F.lit("7"), F.substring(digest, 1, 3)), F.concat(variant, F.substring(digest, 5, 3)), F.substring(digest, 8, 12))


def half_precision(x: Column) -> Column:
    """x rounded to the nearest 16-bit float, halves to even; infinite from 65520 on."""
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    power = F.when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).when(F.pow(F.lit(2.0), guess) > size, guess - 1).otherwise(guess)
    unit = F.pow(F.lit(2.0), F.greatest(power, F.lit(-14)) - 10)
    near = F.rint(x / unit) * unit
    return F.when(size == 0, x).when(size >= 65520, F.signum(x) * float("inf")).otherwise(near)


def nearest_center(i: Column, targets: int, sources: int) -> Column:
    """Of `targets` evenly spread places over `sources` cells, the cell of the i-th; halves to even."""
    return F.rint(i * (sources - 1) / max(1, targets - 1)).cast("long")


def compare(operator: Column, value: Column, threshold: Column) -> Column:
    """value OP threshold for lt, le, gt, ge, eq; false where either is not finite or the operator is unknown."""
    said = F.when(operator == "lt", value < threshold).when(operator == "le", value <= threshold).when(operator == "gt", value > threshold)
    said = said.when(operator == "ge", value >= threshold).when(operator == "eq", value == threshold).otherwise(F.lit(False))
    return finite(value) & finite(threshold) & F.coalesce(said, F.lit(False))


def half_cosine_ramp(step: Column, steps: int) -> Column:
    return F.when(step >= steps, F.lit(1.0)).otherwise(0.5 * (1 - F.cos(F.lit(math.pi) * step / steps)))


def warmup_cosine(epoch: Column, epochs: int, warmup: int, peak: float, floor: float) -> Column:
    """Epochs count from 1: linear from a tenth of the peak over the warm-up, then a cosine to the floor."""
    rising = peak * (0.1 + 0.9 * (epoch - 1) / max(1, warmup - 1))
    falling = floor + (peak - floor) * 0.5 * (1 + F.cos(F.lit(math.pi) * (epoch - warmup) / (epochs - warmup)))
    return F.when(epoch <= warmup, rising).otherwise(falling)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def seconds_to_midnight(ts: Column) -> Column:
    return F.lit(86400) - F.pmod(F.unix_timestamp(ts), F.lit(86400))


# What counts as private in a log line.
PRIVATE = [
    (r"(https?://)[^/\s@]+@", "$1"),
    (r"(https?://[^\s?#]+)[?#]\S*", "$1"),
    (r"(?i)\b(password|passwd|secret|token|api_?key)\b(\s*[:=]\s*)\S+", "$1$2[REDACTED]"),
    (r"(^|[\s(])/(?:home|root|Users|var|etc)/\S+", "$1[PATH]"),
]


def redact(text: Column, patterns: Sequence[tuple[str, str]] = PRIVATE) -> Column:
    for pattern, instead in patterns:
        text = F.regexp_replace(text, pattern, instead)
    return text


def client_of_forwarded(header: Column, trusted: Sequence[str]) -> Column:
    """The rightmost address that is no trusted proxy; the leftmost if all are trusted."""
    hops = F.transform(F.split(header, ","), lambda h: F.trim(h))
    foreign = F.filter(hops, lambda h: ~h.isin(*trusted) & (h != ""))
    return F.when(F.size(foreign) > 0, F.element_at(foreign, -1)).otherwise(F.element_at(hops, 1))
