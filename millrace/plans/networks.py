"""Queries on addresses of both versions and the networks that hold them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import networks
from millrace.plans.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


#: Of every event's user, number u: as version 4 the address 10.u.7u.13u, as version 6 2001:db8:g::u with g = u // 2 mod 40.
_PARTS = "p AS (SELECT event_id, user_id AS u, user_id % 2 = 0 AS four, user_id // 2 % 40 AS g FROM events)"


def _spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, address: version 4 plain or mapped, version 6 with zeros written out, in capitals, or short; some are none."""
    u = F.col("user_id")
    g = F.floor(u / 2) % 40
    octets = F.concat_ws(".", F.lit("10"), u % 256, u * 7 % 256, u * 13 % 256)
    four = F.when(u % 4 == 0, F.concat(F.lit("::FFFF:"), octets)).otherwise(octets)
    long = F.concat(F.lit("2001:0DB8:"), F.lpad(F.hex(g), 4, "0"), F.lit(":0:0:0:0:"), F.lpad(F.hex(u % 65_536), 4, "0"))
    short = F.concat(F.lit("2001:db8:"), F.lower(F.hex(g)), F.lit("::"), F.lower(F.hex(u % 65_536)))
    address = F.when(F.col("event_id") % 50 == 0, F.concat(octets, F.lit("."))).when(u % 2 == 0, four).when(u % 3 == 0, long).otherwise(short)
    return table(spark, sf_dir, "events").select("event_id", "user_id", address.alias("address"))


@query(f"""
    WITH {_PARTS}
    SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN CASE WHEN four THEN 4 ELSE 6 END END AS version,
           CASE WHEN event_id % 50 = 0 THEN NULL WHEN four THEN '10.' || u % 256 || '.' || u * 7 % 256 || '.' || u * 13 % 256
                ELSE '2001:db8:' || CASE WHEN g = 0 THEN '' ELSE lower(to_hex(g)) || ':' END || ':' || lower(to_hex(u % 65536)) END AS address
    FROM p
""")
def canonical_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest spelling of each event's address and its version; null where the text is none."""
    rows = _spelled(spark, sf_dir).select("event_id", networks.address_digits(F.col("address")).alias("digits"))
    return rows.select("event_id", networks.address_version(F.col("digits")).alias("version"), networks.address_text(F.col("digits")).alias("address"))


@query(f"""
    WITH {_PARTS},
    a AS (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN four END AS four, CASE WHEN four THEN (u % 256) * 65536 + (u * 7 % 256) * 256 + u * 13 % 256 ELSE g END AS low FROM p),
    n AS (SELECT true AS four, n_nationkey * 10 * 65536 AS base, 15 AS bits, 17 AS free, n_name AS label FROM nation
          UNION ALL SELECT true, r_regionkey * 32 * 65536, 11, 21, r_name FROM region
          UNION ALL SELECT true, 0, 9, 23, 'all of ' || r_name FROM region
          UNION ALL SELECT false, n_nationkey, 48, 0, n_name FROM nation
          UNION ALL SELECT false, r_regionkey * 8, 45, 3, r_name FROM region),
    m AS (SELECT event_id, arg_min(label, (-bits, label)) AS matched, max(bits) AS matched_bits FROM a JOIN n ON a.four = n.four AND (a.low >> n.free) = (n.base >> n.free) GROUP BY event_id)
    SELECT p.event_id, matched, matched_bits FROM p LEFT JOIN m USING (event_id)
""")
def narrowest_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrowest of overlapping networks that holds each event's address: those of nations lie in those of regions."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    known = nation.select(F.concat(F.lit("10."), n * 10, F.lit(".0.0/15")).alias("network"), F.col("n_name").alias("label"))
    known = known.unionByName(nation.select(F.concat(F.lit("2001:db8:"), F.lower(F.hex(n)), F.lit("::/48")).alias("network"), F.col("n_name").alias("label")))
    known = known.unionByName(region.select(F.concat(F.lit("10."), r * 32, F.lit(".0.0/11")).alias("network"), F.col("r_name").alias("label")))
    known = known.unionByName(region.select(F.concat(F.lit("2001:db8:"), F.hex(r * 8), F.lit("::/45")).alias("network"), F.col("r_name").alias("label")))
    known = known.unionByName(region.select(F.lit("10.0.0.0/9").alias("network"), F.concat(F.lit("all of "), "r_name").alias("label")))
    return networks.narrowest_network(_spelled(spark, sf_dir), "address", known).select("event_id", "matched", "matched_bits")
