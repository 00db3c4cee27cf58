import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import networks

SPELLINGS = [
    "1.2.3.4", " 10.0.0.255 ", "::ffff:1.2.3.4", "::FFFF:0102:0304", "0:0:0:0:0:ffff:1.2.3.4", "::", "::1", "1::", "2001:DB8::1",
    "2001:0db8:0000:0000:0000:0000:0000:0001", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:0:0:2:0:0:0:3", "1:0:0:2:0:0:3:4", "64:ff9b::192.0.2.33", "1:0:2:0:3:0:4:0",
    "0:0:1::", "fe80::a:0:0:b",
]
NO_ADDRESS = [
    "", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1.2.3.4:80", ":::", "1::2::3", ":1::2", "1:2:3:4:5:6:7:8::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::1",
    "::1.2.3", "1.2.3.4::", "::1.2.3.4:5", "fe80::1%eth0", ":", "1:", "ten", None,
]


def _plain(text):
    try:
        found = ipaddress.ip_address(text.strip())
    except (ValueError, AttributeError):
        return None
    return found.ipv4_mapped or found if found.version == 6 else found


def test_spellings(spark):
    made = random.Random(3)
    some = [str(ipaddress.IPv6Address(sum(made.choice([0, 0, 1, made.getrandbits(16)]) << (16 * i) for i in range(8)))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in SPELLINGS + NO_ADDRESS + some], "t string").withColumn("d", networks.address_digits(F.col("t")))
    got = rows.select("t", "d", networks.address_version(F.col("d")).alias("v"), networks.address_text(F.col("d")).alias("s")).collect()
    assert len(got) == len(SPELLINGS) + len(NO_ADDRESS) + len(some)
    for r in got:
        want = None if r.t in NO_ADDRESS else _plain(r.t)
        if want is None:
            assert (r.d, r.v, r.s) == (None, None, None), r
        else:
            whole = want if want.version == 6 else ipaddress.IPv6Address(f"::ffff:{want}")
            assert (r.d, r.v, r.s) == (f"{int(whole):032x}", want.version, str(want)), r


def test_networks_read(spark):
    good = ["10.0.0.0/8", "0.0.0.0/0", "1.2.3.4", "1.2.3.4/32", "2001:db8::/32", "::/0", "::1", "2001:db8::8000:0:0:0/65", "10.32.0.0/11", "::ffff:0:0/96", "::ffff:10.0.0.0/104"]
    bad = ["10.0.0.1/8", "10.0.0.0/33", "2001:db8::1/32", "::/129", "x/8", "10.0.0.0/", "10.0.0.0/8/9", "10.16.0.0/11", "10.0.0.0/-1", None]
    got = {r.t: r.n for r in spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", networks.network_parts(F.col("t")).alias("n")).collect()}
    for t in good:
        want = ipaddress.ip_network(t)
        four = want.version == 4 or t.startswith("::ffff:")
        bits = want.prefixlen + (96 if want.version == 4 else 0)
        first = int(want.network_address) + (0xFFFF << 32 if want.version == 4 else 0)
        assert tuple(got[t]) == (4 if four else 6, bits, f"{first:032x}"), t
    assert [got[t] for t in bad] == [None] * len(bad)


def test_narrowest(spark):
    made = random.Random(5)
    texts = [f"10.{made.randrange(4)}.{made.randrange(4)}.{made.randrange(256)}" for _ in range(150)] + [f"2001:db8:{made.randrange(4):x}::{made.randrange(9):x}" for _ in range(150)]
    texts += ["::ffff:10.1.1.1", "10.1.1.1", "10.1.1.1", "11.0.0.1", "no", None]
    nets = [("10.0.0.0/8", "a"), ("10.0.0.0/9", "b"), ("10.1.0.0/16", "c"), ("10.1.1.0/24", "z"), ("10.1.1.0/24", "d"), ("10.2.2.128/25", "e"), ("10.3.3.7/32", "f"), ("2001:db8::/32", "g"), ("2001:db8:1::/48", "h"), ("2001:db8:2::4/126", "i"), ("::/0", "j"), (None, "k")]
    rows = spark.createDataFrame(list(enumerate(texts)), "matched_by int, address string")
    got = networks.narrowest_network(rows, "address", spark.createDataFrame(nets, "network string, label string"))
    assert got.columns == ["matched_by", "address", "matched", "matched_bits"]
    found = {r.matched_by: (r.matched, r.matched_bits) for r in got.collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        at = _plain(text)
        inside = [(n.prefixlen, x) for t, x in nets if t for n in [ipaddress.ip_network(t)] if at is not None and n.version == at.version and at in n]
        longest = max((b for b, _ in inside), default=None)
        assert found[i] == (min((x for b, x in inside if b == longest), default=None), longest), text


def test_no_networks_and_wrong_ones(spark):
    rows = spark.createDataFrame([("1.2.3.4",)], "address string")
    none = spark.createDataFrame([], "network string, label string")
    assert [tuple(r) for r in networks.narrowest_network(rows, "address", none).collect()] == [("1.2.3.4", None, None)]
    assert networks.narrowest_network(rows.limit(0), "address", none).count() == 0
    with pytest.raises(ValueError, match="no network"):
        networks.narrowest_network(rows, "address", spark.createDataFrame([("10.0.0.1/8", "x")], none.schema))
