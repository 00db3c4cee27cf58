"""Addresses of both versions as sortable keys, and the narrowest network of each address.

An address becomes 32 hexadecimal digits; one of version 4 lies at ::ffff:0:0/96, where its mapped form
lies too, so both are one address of version 4. A network is a version, a number of leading bits and the
digits with all other bits zero. Addresses meet networks by equality: only for the lengths that networks
have is a key made, and there are 162 of them at most (33 + 129), so nothing is compared range by range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalar import address_number

MAPPED = "0" * 20 + "ffff"
_GROUPS = r"[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"
_DIGITS = "0123456789abcdef"


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _groups(part: Column) -> Column:
    return F.filter(F.split(part, ":"), lambda g: g != "")


def _short(number: Column) -> Column:
    return F.lower(F.hex(number))


def address_digits(text: Column) -> Column:
    """32 hexadecimal digits of an address of version 4 or 6, in any spelling; null for anything else.

    Zones (fe80::1%eth0) and leading zeros of decimal parts are refused.
    """
    return _once(F.lower(F.trim(text)), lambda low: F.when(low.contains(":"), _once(_hexadecimal(low), _version_6)).otherwise(_once(address_number(low), _version_4)))


def _version_4(number: Column) -> Column:
    return F.concat(F.lit(MAPPED), F.lpad(_short(number), 8, "0"))


def _hexadecimal(low: Column) -> Column:
    """The text with a dotted ending (::ffff:1.2.3.4) as two groups; null if the ending is no address."""
    last = F.substring_index(low, ":", -1)
    two = _once(address_number(last), lambda n: F.concat(_short(F.shiftright(n, 16)), F.lit(":"), _short(n.bitwiseAND(0xFFFF))))
    return F.when(last.contains("."), F.concat(F.left(low, F.length(low) - F.length(last)), two)).otherwise(low)


def _version_6(six: Column) -> Column:
    gap = F.instr(six, "::")
    before = _groups(F.when(gap > 0, F.left(six, gap - 1)).otherwise(six))
    after = _groups(F.when(gap > 0, F.substring(six, gap + 2, F.length(six))).otherwise(F.lit("")))
    n = F.size(before) + F.size(after)
    good = six.rlike(rf"^(?:{_GROUPS})?(?:::(?:{_GROUPS})?)?$") & F.when(gap > 0, n <= 7).otherwise(n == 8)
    wide = lambda groups: F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")
    return F.when(good, F.concat(wide(before), F.repeat(F.lit("0000"), 8 - n), wide(after)))


def address_version(digits: Column) -> Column:
    return F.when(digits.startswith(MAPPED), 4).when(digits.isNotNull(), 6)


def address_text(digits: Column) -> Column:
    """The shortest spelling: dotted for version 4; for version 6 the first longest run of two zero groups or more is `::`."""
    part = lambda i, n: F.conv(F.substring(digits, i, n), 16, 10)
    dotted = F.concat_ws(".", *[part(i, 2) for i in (25, 27, 29, 31)])
    groups = F.concat_ws(":", *[_short(part(i, 4).cast("long")) for i in range(1, 33, 4)])
    return F.when(address_version(digits) == 4, dotted).when(digits.isNotNull(), _once(groups, _shortest))


def _shortest(groups: Column) -> Column:
    short = groups
    for zeros in range(2, 9):  # the longest run that is there wins
        run = rf"^((?:[0-9a-f]+:)*?)0(?::0){{{zeros - 1}}}(?::(.*)|$)"
        cut = F.concat(F.regexp_replace(F.regexp_extract(groups, run, 1), ":$", ""), F.lit("::"), F.regexp_extract(groups, run, 2))
        short = F.when(groups.rlike(run), cut).otherwise(short)
    return short


def leading_bits(digits: Column, bits: int) -> Column:
    """The digits with all but the first bits set to zero."""
    whole, rest = divmod(bits, 4)
    kept = F.left(digits, F.lit(whole))
    if rest:
        keep = 16 - (1 << (4 - rest))
        kept = F.concat(kept, F.translate(F.substring(digits, whole + 1, 1), _DIGITS, "".join(_DIGITS[i & keep] for i in range(16))))
    return F.rpad(kept, 32, "0")


def network_parts(text: Column) -> Column:
    """version, bits (of 128) and digits of a network such as 10.0.0.0/8 or 2001:db8::/32; null for what is none.

    An address alone is a network of itself. A network with bits set beyond its length is none.
    """
    parts = F.split(F.trim(text), "/")
    dotted = ~parts[0].contains(":")
    whole = F.when(dotted, 32).otherwise(128)
    said = F.when(F.size(parts) == 1, whole).when((F.size(parts) == 2) & parts[1].rlike("^[0-9]{1,3}$"), parts[1].try_cast("int"))
    bits = F.when(said <= whole, F.when(dotted, said + 96).otherwise(said))
    return _once(F.struct(bits.alias("bits"), address_digits(parts[0]).alias("digits")), lambda n: _network(n["bits"], n["digits"]))


def _network(bits: Column, digits: Column) -> Column:
    kept = F.floor(bits / 4).cast("int")
    nibble = F.conv(F.substring(digits, kept + 1, F.lit(1)), 16, 10).cast("int")
    free = F.pow(F.lit(2), 4 - F.pmod(bits, F.lit(4))).cast("int")
    clean = F.substring(digits, kept + 2, F.lit(32)).rlike("^0*$") & F.coalesce(F.pmod(nibble, free) == 0, F.lit(True))
    # A mapped network of 96 bits or more is one of version 4, a wider one of version 6.
    version = F.when(address_version(digits).eqNullSafe(4) & (bits >= 96), 4).otherwise(6)
    return F.when(clean & bits.isNotNull() & digits.isNotNull(), F.struct(version.alias("version"), bits.alias("bits"), digits.alias("digits")))


def narrowest_network(rows: DataFrame, address: str, networks: DataFrame, *, network: str = "network", label: str = "label") -> DataFrame:
    """rows with matched (the label of the narrowest network that holds the address) and matched_bits (its length).

    Both are null where no network holds it or the text is no address. Of labels of one network the smallest
    stands; null networks are left out; one that can't be read is refused. Addresses and networks of different
    versions never meet. Each distinct address is looked up once, however many rows have it.
    """
    named = networks.filter(F.col(network).isNotNull()).select(F.col(network).alias("__text"), F.col(label).alias("__label"), network_parts(F.col(network)).alias("__n"))
    wrong = named.filter("__n is null").select("__text").limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0][0]!r} is no network")
    known = named.select("__n.*", "__label").groupBy("version", "bits", "digits").agg(F.min("__label").alias("__label"))
    lengths = [(r.version, r.bits) for r in known.select("version", "bits").distinct().sort("version", "bits").collect()]  # 162 at most
    keyed = rows.withColumn("__digits", address_digits(F.col(address)))
    distinct = keyed.filter("__digits is not null").select("__digits").distinct().withColumn("__v", address_version(F.col("__digits")))
    keys = [F.when(F.col("__v") == v, F.struct(F.lit(v).alias("version"), F.lit(b).alias("bits"), leading_bits(F.col("__digits"), b).alias("digits"))) for v, b in lengths]
    probes = F.array_compact(F.array(*keys)) if keys else F.array().cast("array<struct<version:int,bits:int,digits:string>>")
    met = distinct.select("__digits", F.explode(probes).alias("__k")).select("__digits", "__k.*").join(known, ["version", "bits", "digits"])
    own = F.when(F.col("version") == 4, F.col("bits") - 96).otherwise(F.col("bits"))
    best = met.groupBy("__digits").agg(F.max_by("__label", "bits").alias("matched"), F.max_by(own, "bits").alias("matched_bits"))
    return keyed.join(best, "__digits", "left").select(*[F.col(f"`{c}`") for c in rows.columns], "matched", "matched_bits")
