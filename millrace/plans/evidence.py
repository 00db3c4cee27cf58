"""Queries on evidence and identity: agreement of tables, digests, summaries for a report, retention, files' forms.

Each query stands with the SQL that gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import scalar
from millrace.operators import checks, evaluation, evidence, joins, profile, sampling, series
from millrace.operators.cut import dealt
from millrace.operators.quantiles import matched, quantiles
from millrace.plans.queries import gate_report, rounded
from millrace.plans.sql import _EVENTS, _GATES, _METRICS
from millrace.plans.tables import event_rows, order_metrics, table
from millrace.sources.strict import strict_objects

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


# -- agreement


@query("""
    WITH lines AS (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS total, min(l_shipdate)::DATE AS day, count(*) AS n FROM lineitem GROUP BY 1),
    m AS (SELECT o_orderkey AS k, round(o_totalprice, 2) AS total, o_orderdate::DATE AS day, o_orderkey % 7 + 1 AS n FROM orders),
    b AS (SELECT m.total = l.total AS total, m.day <= l.day AS day, m.n = l.n AS n FROM m JOIN lines l USING (k))
    SELECT 'total' AS "column", count(*) AS compared, count(*) FILTER (NOT total) AS differ FROM b UNION ALL SELECT 'day', count(*), count(*) FILTER (NOT day) FROM b
    UNION ALL SELECT 'n', count(*), count(*) FILTER (NOT n) FROM b
""")
def evidence_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a manifest against the runs that they name: how many columns do not say the same."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"))
    runs = lines.agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.to_date(F.min("l_shipdate")).alias("day"), F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf_dir, "orders")
    manifest = orders.select(F.col("o_orderkey").alias("k"), F.round("o_totalprice", 2).alias("total"), F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 7 + 1).alias("n"))
    return evidence.agreement(manifest, runs, "k", {"total": lambda m, r: m.eqNullSafe(r), "day": lambda m, r: m <= r, "n": lambda m, r: m.eqNullSafe(r)})


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NULL THEN 'no order' WHEN p_partkey IS NULL THEN 'no part' WHEN s_suppkey IS NULL THEN 'no supplier'
                      WHEN NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = lineitem.l_orderkey AND x.l_returnflag = 'A') THEN 'no accepted parent' ELSE 'known' END AS status
               FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal >= 0) s ON s_suppkey = l_suppkey)
    SELECT status, count(*) AS n FROM l GROUP BY 1
""")
def consumer_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose order, part, supplier in credit and accepted order line are all known; else the first that is not."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    known = [
        ("no order", "l_orderkey", table(spark, sf_dir, "orders").select("o_orderkey")),
        ("no part", "l_partkey", table(spark, sf_dir, "part").select("p_partkey")),
        ("no supplier", "l_suppkey", table(spark, sf_dir, "supplier").filter("s_acctbal >= 0").select("s_suppkey")),
        ("no accepted parent", "l_orderkey", table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("accepted"))),
    ]
    return evidence.identities(lines, known).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH p AS (SELECT l_returnflag AS predictor, l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1, 2), f AS (SELECT DISTINCT l_returnflag AS predictor FROM lineitem),
    r AS (SELECT predictor, p_partkey AS k FROM f, part), b AS (SELECT predictor, r.k AS wanted, p.k AS found, coalesce(n, 0) AS n FROM r FULL JOIN p USING (predictor, k))
    SELECT predictor, count(wanted) AS wanted, count(*) FILTER (found IS NULL) AS missing, count(*) FILTER (wanted IS NULL) AS extra, count(*) FILTER (n > 1) AS repeated FROM b GROUP BY 1
""")
def prediction_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each predictor speaks of each case, once."""
    said = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("predictor"), F.col("l_partkey").alias("k"))
    return evidence.coverage(said, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), "predictor", "k")


@query("""
    WITH c AS (SELECT c_custkey, list_sort(list(DISTINCT o_orderpriority)) AS seen FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT c_custkey, array_to_string(list_filter(['1-URGENT', '2-HIGH', '5-LOW'], lambda x: NOT list_contains(seen, x)), ',') AS lacking,
           array_to_string(list_filter(seen, lambda x: NOT list_contains(['1-URGENT', '2-HIGH', '5-LOW'], x)), ',') AS unasked FROM c
""")
def role_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each consumer the required roles that no parent has, and the parents' roles that nobody asked for."""
    seen = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("seen"))
    roles = table(spark, sf_dir, "customer").select("c_custkey").join(seen, F.col("c_custkey") == F.col("o_custkey"))
    wanted = F.array(*[F.lit(r) for r in ("1-URGENT", "2-HIGH", "5-LOW")])
    return roles.select("c_custkey", F.array_join(F.array_except(wanted, "seen"), ",").alias("lacking"), F.array_join(F.array_except("seen", wanted), ",").alias("unasked"))


@query("""
    SELECT coalesce(a.k, b.k) AS key, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END AS side
    FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL
""")
def key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with open orders alone, or with finished ones alone."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderstatus")
    return checks.key_difference(orders.filter("o_orderstatus = 'O'"), orders.filter("o_orderstatus = 'F'"), "key")


@query(f"""
    WITH {_EVENTS}, b AS (SELECT DISTINCT user_id FROM e WHERE event_type = 'purchase' AND seconds < (SELECT min(seconds) + 15 * 86400 FROM e)),
    a AS (SELECT DISTINCT user_id FROM e WHERE event_type = 'purchase' AND seconds >= (SELECT min(seconds) + 15 * 86400 FROM e))
    SELECT b.user_id, a.user_id IS NOT NULL AS preserved FROM b LEFT JOIN a USING (user_id)
""")
def preserved_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with a success in the first half: whether they have one again in the second."""
    rows = event_rows(spark, sf_dir)
    half = rows.agg((F.min("seconds") + 15 * 86_400).alias("half"))
    rows = rows.filter("event_type = 'purchase'").crossJoin(F.broadcast(half))  # one row
    before = rows.filter("seconds < half").select("user_id").distinct()
    after = rows.filter("seconds >= half").select("user_id").distinct().withColumn("again", F.lit(True))
    return before.join(after, "user_id", "left").select("user_id", F.coalesce("again", F.lit(False)).alias("preserved"))


@query("""
    SELECT s_suppkey, CASE WHEN s_nationkey IS DISTINCT FROM s_suppkey % 25 THEN 'source' WHEN s_acctbal IS NULL OR s_acctbal < 0 THEN 'lock' WHEN length(s_name) > 18 THEN 'config' ELSE 'ready' END AS status FROM supplier
""")
def publication_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part of a release's provenance that is not as it should be; null equals null."""
    rows = table(spark, sf_dir, "supplier")
    reasons = [
        ("source", ~F.col("s_nationkey").cast("long").eqNullSafe(F.col("s_suppkey") % 25)),
        ("lock", F.coalesce(F.col("s_acctbal") < 0, F.lit(True))),
        ("config", F.length("s_name") > 18),
    ]
    return rows.select("s_suppkey", evaluation.readiness(rows, reasons).alias("status"))


# -- identity


@query("""
    WITH p AS (SELECT p_partkey, 0.5 + p_size / 100.0::DOUBLE AS a, p_partkey % 30 / 1.0::DOUBLE AS r, p_retailprice AS n, 1 / ((p_partkey + 1) * 1000.0::DOUBLE) AS t FROM part),
    j AS (SELECT p_partkey, '{"aspect_ratio":' || a || ',"reynolds":' || n || ',"rotation_deg":' || r || ',"tolerance":' || t || '}' AS payload FROM p)
    SELECT p_partkey, payload, sha256(payload)[1:20] AS design_id, sha256('{"design":' || payload || ',"index":' || p_partkey || '}') AS case_id FROM j
""")
def design_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical payload of a design, the id that follows from it, and that of the case which holds it."""
    number = scalar.canonical_number
    fields = {
        "aspect_ratio": number(0.5 + F.col("p_size") / 100),
        "rotation_deg": number((F.col("p_partkey") % 30).cast("double")),
        "reynolds": number(F.col("p_retailprice")),
        "tolerance": number(1 / ((F.col("p_partkey") + 1) * 1000.0)),
    }
    # Shortest texts take long: a small file is one task, so its rows are dealt first.
    rows = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_partkey"], 20_000).select("p_partkey", scalar.canonical_object(fields).alias("payload"))
    case = scalar.canonical_object({"index": F.col("p_partkey"), "design": F.col("payload")})
    return rows.select("p_partkey", "payload", scalar.content_id(F.col("payload")).alias("design_id"), F.sha2(case, 256).alias("case_id"))


@query("""
    WITH r AS (SELECT l_returnflag AS g, l_orderkey // 1000 AS part, l_orderkey AS k, l_linenumber AS n, sha256(l_orderkey || '|' || l_linenumber || '|' || l_shipdate::DATE) AS d FROM lineitem),
    q AS (SELECT g, part, count(*) AS n, sha256(string_agg(d, '' ORDER BY k, n, d)) AS d FROM r GROUP BY 1, 2),
    p AS (SELECT g, q.part // 1000 AS part, sum(n) AS n, sha256(string_agg(q.part || ':' || d, ',' ORDER BY q.part)) AS d FROM q GROUP BY g, q.part // 1000)
    SELECT g AS l_returnflag, sum(n)::BIGINT AS n, sha256(string_agg(part || ':' || d, ',' ORDER BY part)) AS digest FROM p GROUP BY 1
""")
def rollup_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest for the ordered rows of each group, by way of digests of stretches of the key."""
    lines = table(spark, sf_dir, "lineitem")
    row = F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber", F.to_date("l_shipdate").cast("string")), 256)
    rows = lines.select("l_returnflag", "l_orderkey", "l_linenumber", row.alias("digest"))
    return evidence.rollup_digest(rows, ["l_returnflag"], F.floor(F.col("l_orderkey") / 1000), ["l_orderkey", "l_linenumber"], "digest")


_KEY = b"not a secret: a key for tests"
_INNER, _OUTER = (bytes(b ^ pad for b in _KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))


@query(f"""
    WITH h AS (SELECT user_id, sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode(user_id::VARCHAR)))) AS client FROM (SELECT DISTINCT user_id FROM events))
    SELECT user_id, client FROM h
""")
def hashed_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients by the keyed digest of their address, as limits and logs know them."""
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", scalar.hmac_sha256(_KEY, F.col("user_id").cast("string")).alias("client"))


@query("""
    WITH a AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN '::ffff:' ELSE '' END || '10.' || user_id % 256 || '.' || user_id * 7 % 300 || '.' || user_id * 11 % 256 AS address, user_id % 256 AS b, user_id * 7 % 300 AS c, user_id * 11 % 256 AS d
               FROM (SELECT DISTINCT user_id FROM events))
    SELECT user_id, address, CASE WHEN c < 256 THEN 10 * 16777216 + b * 65536 + c * 256 + d END AS number, c < 256 AND b BETWEEN 64 AND 127 AS inside FROM a
""")
def network_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as numbers, mapped ones and wrong ones too, and whether they lie in 10.64.0.0/10."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    u = F.col("user_id")
    address = F.concat(F.when(u % 3 == 0, "::ffff:").otherwise(""), F.concat_ws(".", F.lit("10"), u % 256, u * 7 % 300, u * 11 % 256))
    return users.select("user_id", address.alias("address")).select("user_id", "address", scalar.address_number(F.col("address")).alias("number"), scalar.in_network(F.col("address"), "10.64.0.0/10").alias("inside"))


@query("""
    WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, sha256(event_id::VARCHAR) AS d FROM events)
    SELECT event_id, format('{:012x}', ms)[1:8] || '-' || format('{:012x}', ms)[9:12] || '-7' || d[1:3] || '-' || '89ab'[(('0x' || d[4:4])::BIGINT % 4 + 1):(('0x' || d[4:4])::BIGINT % 4 + 1)] || d[5:7] || '-' || d[8:19] AS id FROM e
""")
def time_ordered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(spark, sf_dir).select("event_id", scalar.time_ordered_id(F.col("ts"), F.col("event_id").cast("string")).alias("id"))


@query("""
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, printf('s%d-case-%04d', l_suppkey, l_linenumber) AS label, printf('%.2f', round(l_extendedprice, 2)) AS price, replace(l_shipmode, '|', chr(92) || '|') AS cell
    FROM (SELECT *, l_returnflag || '|' || l_linestatus AS l_shipmode FROM lineitem)
""")
def formatted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, prices and escaped table cells of a report."""
    cell = F.replace(F.concat_ws("|", "l_returnflag", "l_linestatus"), F.lit("|"), F.lit("\\|"))
    label = F.format_string("s%d-case-%04d", "l_suppkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), label.alias("label"), F.format_string("%.2f", F.round("l_extendedprice", 2)).alias("price"), cell.alias("cell"))


@query("""
    WITH u AS (SELECT DISTINCT user_id FROM events)
    SELECT user_id, CASE WHEN user_id % 3 = 0 THEN '192.0.2.' || user_id % 200 WHEN user_id % 3 = 1 THEN '198.51.100.' || user_id % 200 ELSE '10.0.0.1' END AS client FROM u
""")
def client_of_forwarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address that a chain of proxies forwarded: the last that is no proxy of ours."""
    u = F.col("user_id")
    own = F.lit("10.0.0.1, 10.0.0.2")
    other = F.concat(F.when(u % 3 == 0, "192.0.2.").otherwise("198.51.100."), u % 200)
    header = F.when(u % 3 == 2, own).otherwise(F.concat(F.lit("203.0.113.9, "), other, F.lit(", 10.0.0.2")))
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", scalar.client_of_forwarded(header, ["10.0.0.1", "10.0.0.2"]).alias("client"))


# -- summaries


@query("""
    SELECT l_returnflag, count(*) AS n, round(sum(l_quantity::DECIMAL(18, 4) * l_discount::DECIMAL(18, 4))::DOUBLE / sum(l_quantity::DECIMAL(18, 4))::DOUBLE, 9) AS discount,
           round(sum(l_quantity::DECIMAL(18, 4) * l_tax::DECIMAL(18, 4))::DOUBLE / sum(l_quantity::DECIMAL(18, 4))::DOUBLE, 9) AS tax FROM lineitem GROUP BY 1
""")
def weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means weighted by quantity, from sums that are exact and so the same in any order."""
    said = evidence.weighted_means(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_discount", "l_tax"], "l_quantity", 4)
    return rounded(said.withColumnsRenamed({"l_discount": "discount", "l_tax": "tax"}), 9, "discount", "tax")


@query(f"""
    WITH {_METRICS} SELECT o_orderpriority, count(*) AS n, CASE WHEN count(*) = count(gap_pct) THEN round(avg((gap_pct <= 50)::INT), 9) END AS share,
           CASE WHEN count(*) = count(gap_pct) THEN 'valid' ELSE 'invalid' END AS status FROM metrics GROUP BY 1
""")
def share_passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of orders with a gap of 50 percent at most; none where one order has no gap."""
    said = evidence.share_passing(order_metrics(spark, sf_dir), ["o_orderpriority"], F.col("gap_pct") <= 50, F.col("valid"))
    return rounded(said, 9, "share")


@query("""
    WITH b AS (SELECT l_returnflag AS f, l_suppkey AS s, min((l_extendedprice, l_orderkey * 8 + l_linenumber)) AS m FROM lineitem GROUP BY 1, 2)
    SELECT f AS l_returnflag, arg_min(s, (m[1], s)) AS l_suppkey, min(m[1]) AS score FROM b GROUP BY 1
""")
def best_of_the_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of each supplier, and of those the best supplier of each flag; ties go to the lower number."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", "l_extendedprice", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tie"))
    first = profile.best_of(lines, ["l_returnflag", "l_suppkey"], "l_extendedprice", "tie")
    second = profile.best_of(first, ["l_returnflag"], "l_extendedprice", "l_suppkey")
    return second.select("l_returnflag", "l_suppkey", F.col("l_extendedprice").alias("score"))


@query("""
    SELECT year(o_orderdate)::BIGINT AS epoch, round(quantile_cont(o_totalprice, 0.5), 4) AS price, round(quantile_cont(o_totalprice / (o_custkey + 1), 0.5), 4) AS each, round(quantile_cont(o_totalprice, 0.5) + quantile_cont(o_totalprice / (o_custkey + 1), 0.5), 4) AS score FROM orders GROUP BY 1
""")
def epoch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two medians of each epoch and their sum, the score."""
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("epoch"), "o_totalprice", (F.col("o_totalprice") / (F.col("o_custkey") + 1)).alias("each"))
    cells = profile.long_form(rows, ["o_totalprice", "each"], ["epoch"])
    said = quantiles(cells, ["epoch", "column"], F.col("value"), {"median": 0.5})
    two = said.groupBy("epoch").agg(F.max(F.when(F.col("column") == "o_totalprice", F.col("median"))).alias("price"), F.max(F.when(F.col("column") == "each", F.col("median"))).alias("each"))
    return rounded(two.withColumn("score", F.col("price") + F.col("each")), 4, "price", "each", "score")


@query("""
    SELECT o_orderstatus, count(*) AS n, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS total, max(o_totalprice) AS peak FROM orders GROUP BY 1
""")
def accounting_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact totals and peaks."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(price).cast("double").alias("total"), F.max("o_totalprice").alias("peak"))


@query("""
    WITH v AS (SELECT l_returnflag, l_quantity * l_discount + l_tax AS x FROM lineitem), q AS (SELECT l_returnflag, x, abs(x - CASE WHEN x = 0 THEN x ELSE round_even(x / u, 0) * u END) AS e
               FROM (SELECT *, power(2.0::DOUBLE, greatest(CASE WHEN power(2.0::DOUBLE, g + 1) <= abs(x) THEN g + 1 WHEN power(2.0::DOUBLE, g) > abs(x) THEN g - 1 ELSE g END, -14) - 10) AS u FROM (SELECT *, CASE WHEN x = 0 THEN 0 ELSE floor(log2(abs(x))) END AS g FROM v)))
    SELECT l_returnflag, round(max(e), 12) AS most, round(avg(e), 12) AS mean FROM q GROUP BY 1
""")
def half_precision_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far values move when they are kept as 16-bit floats."""
    x = F.col("l_quantity") * F.col("l_discount") + F.col("l_tax")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.abs(x - scalar.half_precision(x)).alias("e"))
    return rounded(rows.groupBy("l_returnflag").agg(F.max("e").alias("most"), F.avg("e").alias("mean")), 12, "most", "mean")


@query("""
    WITH c AS (SELECT s_suppkey % 8 AS candidate, s_suppkey AS i, s_acctbal / 10000 AS a, s_nationkey / 25.0::DOUBLE AS b FROM supplier),
    d AS (SELECT x.candidate, min(power(x.a - y.a, 2) + power(x.b - y.b, 2)) AS d FROM c x LEFT JOIN c y ON x.candidate = y.candidate AND x.i < y.i GROUP BY 1)
    SELECT candidate, round(d, 9) AS least_distance2, d IS NOT NULL AND row_number() OVER (ORDER BY d DESC NULLS LAST, candidate) = 1 AS chosen FROM d
""")
def maximin_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of candidate designs the one whose two closest points lie furthest apart; ties go to the lowest number."""
    rows = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 8).alias("candidate"), F.col("s_suppkey").alias("i"), (F.col("s_acctbal") / 10_000).alias("a"), (F.col("s_nationkey") / 25).alias("b"))
    return rounded(sampling.maximin(rows, "candidate", "i", ["a", "b"]), 9, "least_distance2")


@query("""
    SELECT k AS "row", round_even(k * 255 / 32.0::DOUBLE, 0)::BIGINT AS centre FROM range(33) t(k)
""")
def centre_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of a fine grid that stand for the rows of a coarse one."""
    return spark.range(33).select(F.col("id").alias("row"), scalar.nearest_center(F.col("id"), 33, 256).alias("centre"))


@query("""
    WITH p AS (SELECT p_size // 13 AS reynolds, p_retailprice AS v, p_partkey FROM part), m AS (SELECT reynolds, quantile_cont(v, 0.5) AS median, count(*) AS n FROM p GROUP BY 1)
    SELECT p_partkey, p.reynolds::BIGINT AS reynolds, round(v, 2) AS v, round(median, 4) AS median, n, CASE WHEN p.reynolds IN (0, 3) THEN 'outside' ELSE 'boundary' END AS regime FROM p JOIN m ON m.reynolds = p.reynolds
""")
def values_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of a plot with its group's median and whether the group lies outside what was trained on."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_size") / 13).alias("reynolds"), F.col("p_retailprice").alias("v"))
    middle = quantiles(rows, ["reynolds"], F.col("v"), {"median": 0.5}, {"n": F.count(F.lit(1))})
    regime = F.when(F.col("reynolds").isin(0, 3), "outside").otherwise("boundary")
    return rounded(rounded(matched(rows, middle, ["reynolds"]), 2, "v"), 4, "median").withColumn("regime", regime)


@query("""
    WITH c AS (SELECT vec_id, label, i - 1 AS i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i)), m AS (SELECT label, i, avg(x) AS mean FROM c GROUP BY 1, 2),
    e AS (SELECT vec_id, c.i, x, mean, abs(x - mean) AS e FROM c JOIN m ON m.label = c.label AND m.i = c.i)
    SELECT vec_id, i, round(e, 6) AS error, round(max(greatest(abs(x), abs(mean))) OVER (), 6) AS field_scale, round(greatest(max(e) OVER (), 1e-12), 6) AS error_scale FROM e
""")
def error_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute errors of the mean predictor, cell by cell, with one scale for both fields and one for the errors."""
    rows = table(spark, sf_dir, "embeddings")
    means = evaluation.mean_vectors(rows, ["label"], "embedding").withColumnRenamed("embedding", "mean")
    cells = rows.join(means, "label").select("vec_id", F.posexplode(F.arrays_zip("embedding", "mean")).alias("i", "c"))
    cells = cells.select("vec_id", F.col("i").cast("long").alias("i"), F.col("c.embedding").cast("double").alias("x"), F.col("c.mean").alias("mean"))
    return rounded(evidence.error_grid(cells, "x", "mean").select("vec_id", "i", "error", "field_scale", "error_scale"), 6, "error", "field_scale", "error_scale")


@query("""
    WITH q AS (SELECT a.vec_id, b.vec_id AS nearest, list_sum(list_transform(range(1, 65), lambda i: power(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
    SELECT vec_id, nearest, round(d, 6) AS distance2 FROM q QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, nearest) = 1
""")
def nearest_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every twentieth embedding the nearest among all others."""
    rows = table(spark, sf_dir, "embeddings")
    wide = rows.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    found = joins.nearest(wide.filter("vec_id % 20 = 0"), wide, "vec_id", [f"e{i}" for i in range(64)], exclude_self=True)
    return rounded(found, 6, "distance2")


@query("""
    SELECT label::BIGINT AS label, count(*) AS n, count(*) FILTER (embedding IS NULL OR len(embedding) <> 64) AS wrong_size, count(*) FILTER (list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))) AS not_finite FROM embeddings GROUP BY 1
""")
def array_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays that have another size or hold what is no finite number, by label."""
    said = checks.array_contract(table(spark, sf_dir, "embeddings"), ["label"], "embedding", 64)
    return said.withColumn("label", F.col("label").cast("long"))


@query(f"""
    {_GATES} SELECT row_number() OVER (ORDER BY name) AS place, '| ' || name || ' | ' || metric || ' | ' || operator || ' | ' || printf('%.4f', threshold) || ' | ' || coalesce(printf('%.4f', value), '') || ' | ' || status || ' |' AS line FROM gated
""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates as a Markdown table."""
    return evaluation.report_lines(gate_report(spark, sf_dir))


@query("""
    WITH s AS (SELECT c_nationkey, (c_acctbal - c_custkey) / 0.5::DOUBLE AS a, (c_acctbal / 2 - c_custkey * 3 % 4000) / 0.5::DOUBLE AS b FROM customer),
    t AS (SELECT c_nationkey, CASE WHEN abs(a) <= 1e-5 THEN 0 ELSE sign(a) END AS a, CASE WHEN abs(b) <= 1e-5 THEN 0 ELSE sign(b) END AS b FROM s)
    SELECT c_nationkey::BIGINT AS c_nationkey, count(*) AS n, count(*) FILTER (a = b) AS n_agree FROM t GROUP BY 1
""")
def slope_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes by central differences of two predictors, and how often they have one sign."""
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("long").alias("c_nationkey"), evaluation.central_slope(balance, key, 0.25).alias("a"), evaluation.central_slope(balance / 2, key * 3 % 4000, 0.25).alias("b")
    )
    return evaluation.sign_agreement(rows, ["c_nationkey"], "a", "b", 1e-5)


# -- order, retention, operations


@query(f"""
    WITH {_EVENTS}, s AS (SELECT event_type, user_id, max(seconds) AS last FROM e GROUP BY 1, 2)
    SELECT event_type, user_id, last, row_number() OVER (PARTITION BY event_type ORDER BY last DESC, user_id DESC) <= 10 AS stays FROM s
""")
def evict_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind's sessions the ten last used stay; the oldest go first."""
    used = event_rows(spark, sf_dir).groupBy("event_type", "user_id").agg(F.max("seconds").alias("last"))
    return evidence.newest(used, ["event_type"], "last", "user_id", 10)


@query(f"""
    WITH {_EVENTS}, j AS (SELECT user_id, max(seconds) AS last, arg_max(event_type, (seconds, event_id)) AS state FROM e GROUP BY 1), n AS (SELECT max(seconds) AS now FROM e)
    SELECT user_id, state, now - last AS age, CASE WHEN state IN ('purchase', 'error') AND now - last > 36000 THEN 'expired' ELSE state END AS status FROM j, n
""")
def terminal_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that ended over ten hours ago expire; those under way stay, whatever their age."""
    return evidence.expire(event_rows(spark, sf_dir), "user_id", "seconds", "event_id", "event_type", ["purchase", "error"], 36_000)


@query(f"""
    WITH {_EVENTS}, s AS (SELECT user_id, event_id, seconds, lead(event_type) OVER w AS next_type, lead(seconds) OVER w AS next_seconds, event_type FROM e WHERE event_type IN ('signup', 'purchase', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY seconds, event_id))
    SELECT user_id, event_id, CASE WHEN next_type IN ('purchase', 'error') THEN next_type ELSE 'open' END AS terminal, CASE WHEN next_type IN ('purchase', 'error') THEN next_seconds - seconds END AS took FROM s WHERE event_type = 'signup'
""")
def operation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts with the terminal event that follows before another start, and how long that took."""
    rows = event_rows(spark, sf_dir)
    return series.spans(rows, ["user_id"], ["seconds", "event_id"], "event_type", ["signup"], ["purchase", "error"]).select("user_id", "event_id", "terminal", "took")


@query(f"""
    WITH {_EVENTS}, d AS (SELECT *, seconds // 86400 AS day FROM e), f AS (SELECT day, min(seconds) AS first FROM d GROUP BY 1)
    SELECT day, count(DISTINCT event_type) FILTER (seconds <= first + 7200) AS members, count(DISTINCT event_type) FILTER (seconds <= first + 7200) >= 3 AS complete FROM d JOIN f USING (day) GROUP BY 1
""")
def barrier_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether three members of a group were complete within two hours from its first."""
    rows = event_rows(spark, sf_dir).withColumn("day", F.floor(F.col("seconds") / 86_400))
    return evidence.barrier(rows, ["day"], "seconds", "event_type", 3, 7200)


@query("""
    WITH c AS (SELECT l_suppkey AS run, l_orderkey AS epoch, min(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2),
    k AS (SELECT run, epoch, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) = 1 AS latest, row_number() OVER (PARTITION BY run ORDER BY score, epoch) = 1 AS best FROM c)
    SELECT run, count(*) AS checkpoints, max(epoch) FILTER (latest) AS latest, max(epoch) FILTER (best) AS best, count(*) FILTER (NOT latest AND NOT best) AS prunable FROM k GROUP BY 1
""")
def checkpoint_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run the checkpoints that `latest` and `best` point to, and how many nothing points to."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_orderkey").alias("epoch")).agg(F.min("l_extendedprice").alias("score"))
    return evidence.pointers(rows, "run", "epoch", "score")


@query("""
    WITH r AS (SELECT o_custkey AS run, o_orderkey AS epoch, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS batches FROM orders),
    s AS (SELECT *, sum(batches) OVER w AS step, lag(epoch) OVER w AS previous FROM r WINDOW w AS (PARTITION BY run ORDER BY epoch))
    SELECT run, count(*) AS epochs, max(step)::BIGINT AS global_step, count(*) FILTER (epoch - previous > 500) AS jumps FROM s GROUP BY 1
""")
def running_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The global step of a log, summed over its epochs in order, and the jumps of the epoch."""
    w = Window.partitionBy("run").orderBy("epoch")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("epoch"))
    rows = rows.withColumn("batches", F.row_number().over(w).cast("long"))
    return series.log_steps(rows, ["run"], "epoch", "batches", 500)


@query("""
    SELECT CASE WHEN json_valid(props) THEN 'read' ELSE 'refused' END AS status, count(*) AS n, 0::BIGINT AS twice FROM events GROUP BY 1
""")
def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that are read under caps on depth and keys, without repeated keys or numbers that are not finite."""
    said = strict_objects(table(spark, sf_dir, "events"), "props")
    return said.groupBy(F.when(F.col("refused").isNull(), "read").otherwise("refused").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("refused") == "repeated key").alias("twice"))
