"""SQL for the queries of queries.py, for an engine with the same tables as views."""

from __future__ import annotations

from millrace.operators.profile import POISSON

_METRICS = """
    lines AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS revenue FROM lineitem GROUP BY l_orderkey),
    metrics AS (
        SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey, coalesce(o_orderpriority, 'none') AS o_orderpriority,
               100 * abs(revenue - o_totalprice) / greatest(abs(o_totalprice), 0.1) AS gap_pct
        FROM orders FULL JOIN lines ON o_orderkey = l_orderkey)
"""

_GATES = f"""
    WITH {_METRICS}, said AS (
        SELECT quantile_cont(gap_pct, 0.5) AS median, quantile_cont(gap_pct, 0.9) AS p90, quantile_cont(gap_pct, 0.95) AS p95, max(gap_pct) AS maximum
        FROM metrics WHERE gap_pct IS NOT NULL
    ), evidence AS (
        SELECT 'gap_pct.median' AS metric, median AS value FROM said UNION ALL SELECT 'gap_pct.p90', p90 FROM said
        UNION ALL SELECT 'gap_pct.p95', p95 FROM said UNION ALL SELECT 'gap_pct.maximum', maximum FROM said
        UNION ALL SELECT 'lines.per_part', count(*)::DOUBLE / count(DISTINCT l_partkey) FROM lineitem
    ), gates(name, metric, operator, threshold) AS (
        VALUES ('median gap', 'gap_pct.median', 'le', 60.0::DOUBLE), ('p90 gap', 'gap_pct.p90', 'le', 500.0), ('p95 gap', 'gap_pct.p95', 'lt', 1000.0),
               ('greatest gap', 'gap_pct.maximum', 'lt', 100.0), ('lines a part', 'lines.per_part', 'ge', 1.0), ('unmeasured', 'nothing.at_all', 'gt', 0.0)
    ), gated AS (
        SELECT name, g.metric, operator, threshold, round(value, 4) AS value,
               CASE WHEN coalesce(CASE operator WHEN 'le' THEN value <= threshold WHEN 'lt' THEN value < threshold
                                                WHEN 'ge' THEN value >= threshold WHEN 'gt' THEN value > threshold END, false) THEN 'green' ELSE 'red' END AS status
        FROM gates g LEFT JOIN evidence e ON e.metric = g.metric)
"""

# The same gates on all orders: one order without a gap leaves no statistic.
_GATES_ALL = _GATES.replace("said AS (", "complete AS (", 1).replace(
    "evidence AS (",
    """said AS (
        SELECT CASE WHEN whole THEN median END AS median, CASE WHEN whole THEN p90 END AS p90, CASE WHEN whole THEN p95 END AS p95, CASE WHEN whole THEN maximum END AS maximum
        FROM complete, (SELECT count(*) = count(gap_pct) AS whole FROM metrics)
    ), evidence AS (""",
    1,
)

# A turned ellipse for each supplier on a 32 x 48 grid, and the fields and drags that the queries put on it.
_GRID = """
    shapes AS (SELECT 's' || s_suppkey AS case_id, 9 + s_suppkey % 4 AS a, 5 + s_suppkey % 3 AS b, radians(s_suppkey * 7 % 30) AS d FROM supplier),
    cells AS (SELECT shapes.*, y, x FROM shapes, range(32) r(y), range(48) c(x)),
    turned AS (SELECT case_id, a, b, y, x, (x - 20) * cos(d) + (y - 15) * sin(d) AS p, (y - 15) * cos(d) - (x - 20) * sin(d) AS q FROM cells),
    ellipse AS (SELECT case_id, y, x, (sqrt(power(p / a, 2) + power(q / b, 2)) - 1) * least(a, b) AS sdf FROM turned),
    box AS (SELECT case_id, min(y) - 1 AS y0, max(y) + 1 AS y1, min(x) - 1 AS x0, max(x) + 1 AS x1 FROM ellipse WHERE sdf < 8 GROUP BY case_id),
    field AS (SELECT case_id, y, x, sdf > 0 AS fluid, sdf <= 0 AS obstacle, 0.1 + x * y / 65536.0::DOUBLE AS u, (x - y) / 2048.0::DOUBLE AS v FROM ellipse),
    drags AS (SELECT 's' || s_suppkey AS case_id, 1 + s_acctbal / 20000 AS solver, 1 + s_acctbal / 20000 + (s_suppkey % 7) / 100.0::DOUBLE AS head, 1 + s_acctbal / 20000 - (s_suppkey % 11) / 50.0::DOUBLE AS field FROM supplier)
"""


# A state for each event of a user, from the one before. Names of what holds after expiry end in 2.
_LEASES = """
    WITH RECURSIVE e AS (
        SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS seconds, ['claim', 'renew', 'succeed', 'fail', 'reap'][event_id % 5 + 1] AS op, event_id % 2 AS owner,
               CASE WHEN event_id % 4 = 0 THEN event_id % 3 + 1 END AS named, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events
    ), walk(user_id, event_id, n, result, state, attempt, owner, expires, codes) AS (
        SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, '', 'pending', 0::BIGINT, NULL::BIGINT, NULL::BIGINT, '' FROM events
        UNION ALL
        SELECT user_id, event_id, n, result,
               CASE WHEN result <> 'ok' OR op IN ('reap', 'renew') THEN state2 WHEN op = 'claim' THEN 'running' WHEN op = 'succeed' THEN 'succeeded' WHEN attempt >= 3 THEN 'failed' ELSE 'pending' END,
               CASE WHEN result = 'ok' AND op = 'claim' THEN attempt + 1 ELSE attempt END,
               CASE WHEN result = 'ok' AND op = 'claim' THEN own WHEN result = 'ok' AND op IN ('succeed', 'fail') THEN NULL ELSE owner2 END,
               CASE WHEN result = 'ok' AND op IN ('claim', 'renew') THEN seconds + 86400 WHEN result = 'ok' AND op IN ('succeed', 'fail') THEN NULL ELSE expires2 END,
               CASE WHEN result = 'ok' AND op = 'fail' THEN codes2 || CASE WHEN codes2 = '' THEN '' ELSE ',' END || 'ERR' ELSE codes2 END
        FROM (SELECT *, CASE WHEN op = 'reap' THEN 'ok' WHEN op = 'claim' THEN CASE WHEN state2 = 'pending' THEN 'ok' ELSE 'refused: ' || state2 END
                             WHEN op = 'succeed' AND state2 = 'succeeded' THEN 'same' WHEN state2 <> 'running' OR own IS DISTINCT FROM owner2 THEN 'refused: no lease'
                             WHEN named IS NOT NULL AND named <> attempt THEN 'refused: other attempt' ELSE 'ok' END AS result
              FROM (SELECT e.user_id, e.event_id, e.n, e.seconds, e.op, e.owner AS own, e.named, w.attempt,
                           CASE WHEN w.state = 'running' AND e.seconds >= w.expires THEN CASE WHEN w.attempt >= 3 THEN 'failed' ELSE 'pending' END ELSE w.state END AS state2,
                           CASE WHEN w.state = 'running' AND e.seconds >= w.expires THEN NULL ELSE w.owner END AS owner2,
                           CASE WHEN w.state = 'running' AND e.seconds >= w.expires THEN NULL ELSE w.expires END AS expires2,
                           CASE WHEN w.state = 'running' AND e.seconds >= w.expires THEN w.codes || CASE WHEN w.codes = '' THEN '' ELSE ',' END || 'LEASE_EXPIRED' ELSE w.codes END AS codes2
                    FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
    )
"""


def _summary(where: str) -> str:
    whole = "count(*) = count(gap_pct)"
    stats = ", ".join(f"CASE WHEN {whole} THEN round({f}, 4) END AS {n}" for n, f in (("median", "quantile_cont(gap_pct, 0.5)"), ("p90", "quantile_cont(gap_pct, 0.9)"), ("p95", "quantile_cont(gap_pct, 0.95)"), ("maximum", "max(gap_pct)")))
    return f"WITH {_METRICS} SELECT o_orderpriority, count(*) AS n, count(gap_pct) AS n_valid, {stats}, CASE WHEN {whole} THEN 'valid' ELSE 'invalid' END AS status FROM metrics {where} GROUP BY o_orderpriority"


def _profile() -> str:
    one = "SELECT '{0}' AS \"column\", count(*) AS n, count(*) - count({0}) AS n_null, round(min({0}), 4) AS minimum, round(max({0}), 4) AS maximum, round(avg({0}), 4) AS mean, round(stddev_pop({0}), 4) AS std, round(quantile_cont({0}, 0.05), 4) AS q05, round(quantile_cont({0}, 0.5), 4) AS q50, round(quantile_cont({0}, 0.95), 4) AS q95 FROM lineitem"
    return " UNION ALL ".join(one.format(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


def _correlations() -> str:
    columns = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in columns for b in columns)


def _design() -> str:
    dims = {"aspect_ratio": (0.5, 1.0), "rotation": (0.0, 30.0), "reynolds": (40.0, 300.0)}
    parts = ", ".join(f"round({a} + (row_number() OVER (ORDER BY sha256('design-v1|{n}|' || i), i) - 1 + 0.5) / 256 * {b - a}, 8) AS {n}" for n, (a, b) in dims.items())
    return f'SELECT i AS "index", {parts} FROM range(256) t(i)'


_EVENTS = "e AS (SELECT *, floor(epoch(ts))::BIGINT AS seconds FROM events)"
_OVERLAP = "greatest(0, least(i + 1, (b + 1) * {w}) - greatest(i, b * {w}))"

SQL: dict[str, str] = {
    "gate_report": f"{_GATES} SELECT * FROM gated",
    "gate_verdict": f"{_GATES} SELECT count(*) AS gates, count(*) FILTER (status = 'green') AS green, CASE WHEN count(*) = count(*) FILTER (status = 'green') THEN 'green' ELSE 'red' END AS status FROM gated",
    "gate_report_all_orders": f"{_GATES_ALL} SELECT * FROM gated",
    "gate_verdict_all_orders": f"{_GATES_ALL} SELECT count(*) AS gates, count(*) FILTER (status = 'green') AS green, CASE WHEN count(*) = count(*) FILTER (status = 'green') THEN 'green' ELSE 'red' END AS status FROM gated",
    "metric_summary_fail_closed": _summary(""),
    "metric_summary_complete": _summary("WHERE gap_pct IS NOT NULL"),
    "worst_orders": f"WITH {_METRICS} SELECT o_orderkey, o_orderpriority, round(gap_pct, 4) AS gap_pct, row_number() OVER (ORDER BY metrics.gap_pct DESC, o_orderkey) AS place FROM metrics WHERE gap_pct IS NOT NULL QUALIFY place <= 20",
    "column_profile": _profile(),
    "distribution_by_priority": "SELECT o_orderpriority, count(*) AS n, round(min(o_totalprice), 2) AS minimum, round(max(o_totalprice), 2) AS maximum, round(avg(o_totalprice), 2) AS mean, "
    + ", ".join(f"round(quantile_cont(o_totalprice, 0.{q}), 2) AS q{q}" for q in ("05", "25", "50", "75", "95"))
    + " FROM orders GROUP BY o_orderpriority",
    "correlation_matrix": _correlations(),
    "representative_and_worst": """
        WITH m AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.5) AS median FROM customer GROUP BY 1), r AS (
            SELECT c.c_mktsegment, median, c_custkey, row_number() OVER (PARTITION BY c.c_mktsegment ORDER BY abs(c_acctbal - median), c_custkey) AS a,
                   row_number() OVER (PARTITION BY c.c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS b FROM customer c JOIN m USING (c_mktsegment))
        SELECT c_mktsegment, round(min(median), 4) AS median, max(c_custkey) FILTER (a = 1) AS representative, max(c_custkey) FILTER (b = 1) AS extreme FROM r GROUP BY 1
    """,
    "group_argmin_selection": "SELECT l_suppkey, l_extendedprice, l_orderkey * 8 + l_linenumber AS tie FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey * 8 + l_linenumber) = 1",
    "value_ranks": """
        SELECT p_brand, p_size::BIGINT AS p_size, n, round(sum(n) OVER (PARTITION BY p_brand ORDER BY p_size)::DOUBLE / sum(n) OVER (PARTITION BY p_brand), 6) AS share
        FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2)
    """,
    "rule_violations": """
        SELECT code, n FROM (
            SELECT 'quantity' AS code, count(*) FILTER (NOT coalesce(l_quantity BETWEEN 1 AND 50, false)) AS n FROM lineitem
            UNION ALL SELECT 'discount', count(*) FILTER (NOT coalesce(l_discount >= 0 AND l_discount <= 0.1, false)) FROM lineitem
            UNION ALL SELECT 'cheap', count(*) FILTER (NOT coalesce(l_extendedprice < 50000, false)) FROM lineitem
            UNION ALL SELECT 'returned_open', count(*) FILTER (coalesce(l_returnflag = 'R' AND l_linestatus = 'O', true)) FROM lineitem) WHERE n > 0
    """,
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "complete_join_audit": """
        WITH o AS (SELECT o_orderkey AS key, count(*) AS a FROM orders GROUP BY 1), l AS (SELECT l_orderkey AS key, count(*) AS b FROM lineitem GROUP BY 1)
        SELECT CASE WHEN b IS NULL THEN 'left_only' WHEN a IS NULL THEN 'right_only' WHEN a > 1 OR b > 1 THEN 'duplicate' ELSE 'matched' END AS status,
               count(*) AS n, sum(coalesce(b, 0))::BIGINT AS lines FROM o FULL JOIN l USING (key) GROUP BY 1
    """,
    "missing_parents": """
        SELECT DISTINCT 'orders.customer' AS link, o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
        UNION SELECT 'lineitem.orders', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
        UNION SELECT 'lineitem.part', l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
        UNION SELECT 'lineitem.supplier', l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
        UNION SELECT 'customer.orders', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
        UNION SELECT 'lineitem.open_orders', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')
    """,
    "artifact_difference": """
        WITH r AS (SELECT *, sha256(c_custkey || '|' || c_name || '|' || c_mktsegment) AS sha FROM customer),
        e AS (SELECT c_custkey, sha FROM r WHERE c_acctbal < 9000), f AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'old' ELSE sha END AS sha FROM r WHERE c_acctbal > 0)
        SELECT c_custkey, CASE WHEN f.sha IS NULL THEN 'missing' WHEN e.sha IS NULL THEN 'extra' WHEN e.sha = f.sha THEN 'same' ELSE 'stale' END AS status FROM e FULL JOIN f USING (c_custkey)
    """,
    "nearest_design": """
        WITH u AS (SELECT p_partkey, (p_size - 1) / 49.0::DOUBLE AS size, (p_retailprice - 900) / 1200.0::DOUBLE AS price FROM part)
        SELECT q.p_partkey, r.p_partkey AS nearest, round(power(r.size - q.size, 2) + power(r.price - q.price, 2), 8) AS distance2 FROM u q JOIN u r ON r.p_partkey % 20 <> 0
        WHERE q.p_partkey % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.p_partkey ORDER BY power(r.size - q.size, 2) + power(r.price - q.price, 2), r.p_partkey) = 1
    """,
    "nearest_design_all_parts": """
        WITH u AS (SELECT p_partkey, (p_size - 1) / 49.0::DOUBLE AS size, (p_retailprice - 900) / 1200.0::DOUBLE AS price FROM part)
        SELECT q.p_partkey, r.p_partkey AS nearest, round(power(r.size - q.size, 2) + power(r.price - q.price, 2), 8) AS distance2 FROM u q JOIN u r ON r.p_partkey <> q.p_partkey
        WHERE q.p_partkey % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.p_partkey ORDER BY power(r.size - q.size, 2) + power(r.price - q.price, 2), r.p_partkey) = 1
    """,
    "shared_neighbours": """
        WITH m AS (SELECT o_custkey, bool_or(o_orderstatus = 'O') AS a, bool_or(o_orderstatus = 'F') AS b FROM orders GROUP BY 1)
        SELECT part, count(*) AS n, sum(o_custkey)::BIGINT AS sum_key FROM m, (VALUES ('both'), ('first_only'), ('either')) k(part)
        WHERE CASE part WHEN 'both' THEN a AND b WHEN 'first_only' THEN a AND NOT b ELSE a OR b END GROUP BY 1
    """,
    "probe_grid": """
        SELECT n_nationkey, n_name, reynolds, member, CASE WHEN reynolds IN (20, 400) THEN 'ood' ELSE 'boundary' END AS regime
        FROM nation, (VALUES (20::BIGINT), (40), (300), (400)) r(reynolds), (VALUES ('m17'), ('m23'), ('m31')) m(member)
    """,
    "hash_rank_split": """
        WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('split-v1|' || c_custkey), c_custkey) - 1 AS place, count(*) OVER () AS n FROM customer)
        SELECT c_custkey, CASE WHEN place < floor(n * 0.6::DOUBLE) THEN 'train' WHEN place < floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM r
    """,
    "split_counts": """
        WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('split-v1|' || c_custkey), c_custkey) - 1 AS place, count(*) OVER () AS n FROM customer)
        SELECT CASE WHEN place < floor(n * 0.6::DOUBLE) THEN 'train' WHEN place < floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'validation' ELSE 'test' END AS split, count(*) AS n, min(c_custkey) AS first FROM r GROUP BY 1
    """,
    "hash_topk_probe": "SELECT p_partkey, p_name, sha256('probe-v1|' || p_partkey) AS digest FROM part WHERE p_size BETWEEN 2 AND 49 ORDER BY digest, p_partkey LIMIT 10",
    "epoch_batches": """
        WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('orders|17|3|' || o_orderkey), o_orderkey) - 1 AS place FROM orders)
        SELECT o_orderkey, place, place // 64 AS batch FROM r
    """,
    "stratified_design": _design(),
    "mean_vector": "SELECT label::BIGINT AS label, i - 1 AS i, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2",
    "zscore_train_only": """
        WITH m AS (SELECT avg(l_quantity) AS qm, greatest(stddev_pop(l_quantity), 1e-6) AS qs, avg(l_extendedprice) AS pm, greatest(stddev_pop(l_extendedprice), 1e-6) AS ps FROM lineitem WHERE l_returnflag <> 'R'),
        r AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, max(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2)
        SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round((q - qm) / qs, 5) AS z_quantity, round((p - pm) / ps, 5) AS z_price, round(q, 4) AS quantity_again FROM r, m
    """,
    "ensemble_variance": """
        WITH l AS (SELECT l_returnflag, l_partkey, l_extendedprice / l_quantity AS unit FROM lineitem), s AS (SELECT l_returnflag, var_pop(unit) AS scale FROM l GROUP BY 1),
        c AS (SELECT l_returnflag, l_partkey, var_pop(unit) AS v FROM l GROUP BY 1, 2)
        SELECT l_returnflag, count(*) AS cells, round(avg(v / scale), 5) AS variance FROM c JOIN s USING (l_returnflag) GROUP BY 1
    """,
    "regime_ratio": """
        WITH m AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) FILTER (o_orderstatus = 'F') AS a, quantile_cont(o_totalprice, 0.5) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY 1)
        SELECT o_orderpriority, round(a, 4) AS top, round(b, 4) AS bottom, round(a / nullif(b, 0), 4) AS ratio, CASE WHEN a / nullif(b, 0) IS NULL THEN 'invalid' ELSE 'valid' END AS status FROM m
    """,
    "sign_agreement": """
        WITH r AS (SELECT c_nationkey, CASE WHEN abs(c_acctbal) <= 1e-5 THEN 0 ELSE sign(c_acctbal) END AS a, CASE WHEN abs(10000 - c_custkey * 7 % 20000) <= 1e-5 THEN 0 ELSE sign(10000 - c_custkey * 7 % 20000) END AS b FROM customer)
        SELECT c_nationkey::BIGINT AS c_nationkey, count(*) AS n, count(*) FILTER (a = b) AS n_agree FROM r GROUP BY 1
    """,
    "sequence_gaps": """
        WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem), s AS (
            SELECT *, coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) + 1, 1) AS expected FROM r)
        SELECT l_orderkey, l_linenumber, expected, CASE WHEN l_linenumber < expected THEN 'repeated' ELSE 'gap' END AS problem FROM s WHERE l_linenumber <> expected
    """,
    "conversation_turns": """
        WITH m AS (SELECT conv_id, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, role AS state FROM conversations),
        t AS (SELECT DISTINCT conv_id, turn FROM conversations), g AS (SELECT conv_id, turn, coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1, 0) AS expected FROM t)
        SELECT conv_id, previous || ' to ' || state AS what, count(*) AS n FROM m WHERE previous IS NOT NULL AND NOT (previous = 'user' AND state = 'assistant') GROUP BY 1, 2
        UNION ALL SELECT conv_id, 'turns', count(*) FROM g WHERE turn <> expected GROUP BY 1
    """,
    "regular_sampling": f"""
        WITH {_EVENTS}, d AS (SELECT user_id, seconds - lag(seconds) OVER (PARTITION BY user_id ORDER BY seconds) AS d FROM e)
        SELECT user_id, count(*) AS n, count(DISTINCT d) AS n_steps, min(d) AS least, max(d) AS greatest, count(DISTINCT d) = 1 AND min(d) > 0 AS regular FROM d GROUP BY 1
    """,
    "trailing_range_mean": f"""
        WITH {_EVENTS} SELECT event_id, count(*) OVER w AS n_trailing, round(avg(value) OVER w, 5) AS trailing_mean
        FROM e WINDOW w AS (PARTITION BY user_id ORDER BY seconds RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)
    """,
    "last_day_mean": f"""
        WITH {_EVENTS}, l AS (SELECT event_type, max(seconds) AS last FROM e GROUP BY 1)
        SELECT event_type, count(*) AS n, round(avg(value), 5) AS mean FROM e JOIN l USING (event_type) WHERE seconds > last - 86400 GROUP BY 1
    """,
    "spectral_peak": f"""
        WITH {_EVENTS}, hours AS (SELECT unnest(range((SELECT min(seconds) // 3600 FROM e), (SELECT max(seconds) // 3600 + 1 FROM e))) AS hour),
        kinds AS (SELECT DISTINCT event_type FROM e), counts AS (SELECT event_type, seconds // 3600 AS hour, count(*) AS c FROM e GROUP BY 1, 2),
        s AS (SELECT k.event_type, row_number() OVER (PARTITION BY k.event_type ORDER BY h.hour) - 1 AS i, count(*) OVER (PARTITION BY k.event_type) AS n, coalesce(c, 0)::DOUBLE AS v
              FROM kinds k CROSS JOIN hours h LEFT JOIN counts USING (event_type, hour)),
        w AS (SELECT event_type, i, n, 0.5 * (1 - cos(2 * pi() * i / (n - 1))) * (v - avg(v) OVER (PARTITION BY event_type)) AS w FROM s),
        p AS (SELECT event_type, b, min(n) AS n, sqrt(power(sum(w * cos(2 * pi() * b * i / n)), 2) + power(sum(w * sin(2 * pi() * b * i / n)), 2)) AS p
              FROM w, (SELECT unnest(range(1, 400)) AS b) WHERE b >= ceil(n / 48.0::DOUBLE) AND b <= floor(n / 4.0::DOUBLE) GROUP BY 1, 2),
        q AS (SELECT *, ln(lag(p) OVER o) AS la, ln(p) AS lb, ln(lead(p) OVER o) AS lc, row_number() OVER (PARTITION BY event_type ORDER BY p DESC, b) AS place FROM p WINDOW o AS (PARTITION BY event_type ORDER BY b))
        SELECT event_type, n, round((b + coalesce(0.5 * (la - lc) / (la - 2 * lb + lc), 0)) / n, 5) AS frequency, round(p, 5) AS power, NULL::VARCHAR AS failure FROM q WHERE place = 1
    """,
    "debounce_last_wins": f"WITH {_EVENTS} SELECT user_id, event_id, seconds FROM e QUALIFY coalesce(lead(seconds) OVER (PARTITION BY user_id ORDER BY seconds, event_id) - seconds > 3600, true)",
    "replay_after_cursor": """
        WITH c AS (SELECT user_id, event_id, max(event_id) OVER (PARTITION BY user_id) AS last FROM events) SELECT user_id, event_id FROM c WHERE event_id > least(5000, last)
    """,
    "future_cursors": """
        SELECT user_id, CASE WHEN user_id % 10 = 0 THEN 1000000000000 ELSE user_id END AS cursor, max(event_id) AS last FROM events GROUP BY 1, 2 HAVING cursor > last
    """,
    "monotone_progress": f"""
        WITH {_EVENTS}, p AS (SELECT user_id, event_id, seconds, event_id * 37 % 1100 / 1000.0::DOUBLE AS v FROM e),
        f AS (SELECT *, CASE WHEN v >= 0 AND v < 1 THEN v END AS fit FROM p),
        a AS (SELECT user_id, coalesce(fit > coalesce(max(fit) OVER (PARTITION BY user_id ORDER BY seconds, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), false) AS ok FROM f)
        SELECT user_id, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS ignored FROM a GROUP BY 1
    """,
    "grid_sensitivity": """
        WITH r AS (SELECT o_orderpriority, year(o_orderdate)::BIGINT AS year, avg(o_totalprice) AS mean, count(*) AS n FROM orders GROUP BY 1, 2),
        d AS (SELECT *, abs(mean - lag(mean) OVER w) AS md, abs(n - lag(n) OVER w) AS nd FROM r WINDOW w AS (PARTITION BY o_orderpriority ORDER BY year))
        SELECT o_orderpriority, year, round(mean, 2) AS mean, n, round(md, 2) AS mean_delta, nd AS n_delta, md < lag(md) OVER w AS mean_contracts, nd < lag(nd) OVER w AS n_contracts
        FROM d WINDOW w AS (PARTITION BY o_orderpriority ORDER BY year)
    """,
    "ellipse_sdf_grid": f"WITH {_GRID} SELECT case_id, y, x, round(sdf, 6) AS sdf, sdf <= 0 AS obstacle, round(greatest(least(sdf / 18, 1), -1), 6) AS channel FROM ellipse",
    "obstacle_box": f"""
        WITH {_GRID} SELECT case_id, y0, y1, x0, x1, round(min(sdf), 6) AS least_on_side FROM box LEFT JOIN (
            SELECT e.case_id AS c, sdf FROM ellipse e JOIN box b ON b.case_id = e.case_id
            WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 AND (y = y0 OR y = y1 OR x = x0 OR x = x1)) ON c = case_id GROUP BY ALL
    """,
    "case_metrics": f"""
        WITH {_GRID}, m AS (SELECT *, u * 1.25::DOUBLE AS pu, v - 0.0625::DOUBLE AS pv FROM field),
        n AS (SELECT *, (lead(pu) OVER r - lag(pu) OVER r) / 4 + (lead(pv) OVER c - lag(pv) OVER c) / 4 AS pd, (lead(u) OVER r - lag(u) OVER r) / 4 + (lead(v) OVER c - lag(v) OVER c) / 4 AS sd,
                     fluid AND lag(fluid) OVER r AND lead(fluid) OVER r AND lag(fluid) OVER c AND lead(fluid) OVER c AS whole
              FROM m WINDOW r AS (PARTITION BY case_id, y ORDER BY x), c AS (PARTITION BY case_id, x ORDER BY y)),
        d AS (SELECT case_id, avg(abs(pd)) AS pd, avg(abs(sd)) AS sd FROM n WHERE coalesce(whole, false) GROUP BY 1),
        w AS (SELECT case_id, sqrt(sum(power(pu - u, 2) + power(pv - v, 2)) FILTER (fluid)) / greatest(sqrt(sum(u * u + v * v) FILTER (fluid)), 1e-8) AS l2,
                     avg(sqrt(pu * pu + pv * pv)) FILTER (obstacle) / 0.1::DOUBLE AS inside FROM m GROUP BY 1)
        SELECT w.case_id, round(l2, 6) AS relative_l2, round(inside, 6) AS obstacle_speed, round(pd, 6) AS pred_divergence, round(sd, 6) AS sol_divergence,
               round(100 * abs(head - solver) / greatest(abs(solver), 0.1), 6) AS head_error, round(100 * abs(field - solver) / greatest(abs(solver), 0.1), 6) AS field_error,
               round(100 * abs(head - field) / greatest(abs(solver), 0.1), 6) AS gap FROM w JOIN drags USING (case_id) LEFT JOIN d USING (case_id)
    """,
    "disagreement_flags": f"""
        WITH {_GRID} SELECT case_id, round(100 * abs(head - field) / greatest(abs(solver), 0.1), 6) AS gap, abs(head - field) > 0.1 * greatest(abs(solver), 0.1) AS disagrees,
               CASE WHEN 100 * abs(head - field) / greatest(abs(solver), 0.1) <= 10 THEN 'green' ELSE 'red' END AS status,
               round(min(least(head, field, solver)) OVER (), 6) AS axis_low, round(max(greatest(head, field, solver)) OVER (), 6) AS axis_high FROM drags
    """,
    "masked_loss": f"""
        WITH {_GRID}, t AS (
            SELECT case_id, avg(CASE WHEN fluid THEN power(u * 0.25::DOUBLE, 2) ELSE 0 END) / greatest(avg(CASE WHEN fluid THEN u * u ELSE 0 END), 1e-6) AS lu,
                   avg(CASE WHEN fluid THEN power(0.0625::DOUBLE, 2) ELSE 0 END) / greatest(avg(CASE WHEN fluid THEN v * v ELSE 0 END), 1e-6) AS lv,
                   avg(CASE WHEN obstacle THEN power(u * 1.25::DOUBLE, 2) + power(v - 0.0625::DOUBLE, 2) ELSE 0 END) / 0.01::DOUBLE AS lo FROM field GROUP BY 1),
        c AS (SELECT t.*, power((head - solver) / greatest(abs(solver), 0.1), 2) AS lc FROM t JOIN drags USING (case_id))
        SELECT case_id, round(lu, 6) AS loss_u, round(lv, 6) AS loss_v, round(lo, 6) AS loss_obstacle, round(lc, 6) AS loss_cd, round(lu + lv + 0.25 * lo + 0.5 * lc, 6) AS total FROM c
    """,
    "vorticity_grid": f"""
        WITH {_GRID}, f AS (SELECT case_id, y, x, u, v * v AS v FROM field), g AS (
            SELECT case_id, y, x, coalesce((lead(v) OVER r - lag(v) OVER r) / 2, (-3 * v + 4 * lead(v) OVER r - lead(v, 2) OVER r) / 2, (3 * v - 4 * lag(v) OVER r + lag(v, 2) OVER r) / 2)
                       - coalesce((lead(u) OVER c - lag(u) OVER c) / 2, (-3 * u + 4 * lead(u) OVER c - lead(u, 2) OVER c) / 2, (3 * u - 4 * lag(u) OVER c + lag(u, 2) OVER c) / 2) AS w
            FROM f WINDOW r AS (PARTITION BY case_id, y ORDER BY x), c AS (PARTITION BY case_id, x ORDER BY y))
        SELECT case_id, y, x, round(w, 9) AS vorticity FROM g WHERE y % 4 = 0 AND x % 2 = 0
    """,
    "control_flux": f"""
        WITH {_GRID}, f AS (SELECT case_id, y, x, u, v, 1 + x / 4096.0::DOUBLE - y / 8192.0::DOUBLE AS rho FROM field), i AS (
            SELECT f.*, y0, y1, x0, x1 FROM f JOIN box b ON b.case_id = f.case_id WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1)
        SELECT case_id, round(coalesce(sum((rho - 1) / 3 + rho * u * u) FILTER (x = x0), 0) - coalesce(sum((rho - 1) / 3 + rho * u * u) FILTER (x = x1), 0)
                   + coalesce(sum(rho * u * v) FILTER (y = y0), 0) - coalesce(sum(rho * u * v) FILTER (y = y1), 0), 7) AS force_x,
               round(coalesce(sum((rho - 1) / 3) FILTER (x = x0), 0), 7) AS left_pressure, round(coalesce(sum(rho * u * u) FILTER (x = x1), 0), 7) AS right_uu,
               round(coalesce(sum(rho * u * v) FILTER (y = y1), 0), 7) AS top_uv FROM i GROUP BY 1
    """,
    "snapshot_stability": f"""
        WITH {_GRID}, f AS (SELECT case_id, step, u, v, 1 + x * step / 128.0::DOUBLE AS rho FROM field, range(3) s(step)), m AS (
            SELECT case_id, step, min(rho) AS a, max(rho) AS b, max(sqrt(u * u + v * v)) AS c, sum(rho) AS mass FROM f GROUP BY 1, 2)
        SELECT case_id, step, round(a, 6) AS least_rho, round(b, 6) AS greatest_rho, round(c, 6) AS fastest, round(mass, 6) AS mass, a >= 0.5 AND b <= 1.5 AND c <= 0.2 AS stable,
               round(abs(mass - first_value(mass) OVER w) / first_value(mass) OVER w, 6) AS drift FROM m WINDOW w AS (PARTITION BY case_id ORDER BY step)
    """,
    "time_average": f"""
        WITH {_GRID}, h AS (SELECT case_id, y, x, u * (1 + step) AS u FROM field, range(4) s(step)), e AS (SELECT case_id, min(u) AS a, max(u) AS b FROM h GROUP BY 1)
        SELECT case_id, y, x, round(avg(u), 8) AS u, round(min(a), 8) AS least, round(min(b), 8) AS greatest FROM h JOIN e USING (case_id) GROUP BY 1, 2, 3
    """,
    "area_average": f"""
        WITH cx AS (SELECT i, b, {_OVERLAP.format(w="2.4::DOUBLE")} AS o FROM range(48) t(i), range(20) s(b)), cy AS (SELECT i, b, {_OVERLAP.format(w="(32 / 12.0::DOUBLE)")} AS o FROM range(32) t(i), range(12) s(b)),
        v AS (SELECT cy.b AS y, cx.b AS x, round(sum((cy.i + 2 * cx.i) * cx.o * cy.o) / (2.4::DOUBLE * 32 / 12.0::DOUBLE), 6) AS value FROM cx, cy WHERE cx.o > 0 AND cy.o > 0 GROUP BY 1, 2)
        SELECT 's' || s_suppkey AS case_id, y, x, value FROM supplier, v
    """,
    "grid_connectivity": """
        WITH RECURSIVE g AS (
            SELECT 's' || s_suppkey AS case_id, y, x, CASE WHEN s_suppkey % 5 < 3 THEN x % 4 = 2 AND y <> CASE WHEN x % 8 = 2 THEN 1 ELSE 10 END ELSE x = 6 + s_suppkey % 5 OR x = y END AS solid
            FROM supplier, range(12) a(y), range(16) b(x)
        ), reach AS (
            SELECT case_id, y, x FROM g WHERE x = 0 AND NOT solid
            UNION SELECT g.case_id, g.y, g.x FROM reach r CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(cy, cx)
            JOIN g ON g.case_id = r.case_id AND g.y = r.y + cy AND g.x = r.x + cx AND NOT g.solid)
        SELECT case_id, bool_or(x = 15) AS connected FROM reach GROUP BY 1
    """,
    "lineage_levels": """
        WITH RECURSIVE edges AS (SELECT * FROM (
            SELECT 'nation:' || n_nationkey AS child, 'region:' || n_regionkey AS parent FROM nation UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
            UNION SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders
        )), walk AS (
            SELECT DISTINCT parent AS sha, 0 AS level FROM edges WHERE parent NOT IN (SELECT child FROM edges)
            UNION SELECT e.child, level + 1 FROM walk JOIN edges e ON e.parent = walk.sha
        ), levels AS (SELECT sha, max(level) AS level FROM walk GROUP BY 1)
        SELECT level::BIGINT AS level, count(*) AS n, min(sha) AS first, max(sha) AS last FROM levels GROUP BY 1
    """,
    "lineage_problems": """
        WITH e AS (SELECT 'c' || c_custkey AS child, CASE WHEN c_acctbal > 9500 THEN 'n999' ELSE 'n' || c_nationkey END AS parent, CASE WHEN c_acctbal BETWEEN 0 AND 200 THEN 'region' ELSE 'nation' END AS kind FROM customer WHERE c_acctbal > -900)
        SELECT 'missing_parent' AS code, child AS subject FROM e WHERE parent = 'n999'
        UNION SELECT 'parent_kind', child FROM e WHERE kind = 'region' AND parent <> 'n999'
        UNION SELECT 'barred_parent', child FROM e WHERE kind = 'region'
        UNION SELECT 'lacks_parent', child FROM e WHERE kind = 'region'
        UNION SELECT 'lacks_parent', 'c' || c_custkey FROM customer WHERE NOT c_acctbal > -900
    """,
    "content_identity": """
        WITH r AS (SELECT n_nationkey::BIGINT AS n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS canonical FROM nation)
        SELECT n_nationkey, canonical, sha256(canonical) AS sha256, sha256(canonical)[1:20] AS id, ('0x' || sha256(canonical)[1:8])::BIGINT AS seed FROM r
    """,
    "redact_text": r"""
        WITH r AS (SELECT 'd' || doc_id AS id, text AS before FROM documents UNION ALL SELECT 'p' || page_id, url FROM pages), a AS (SELECT id, before,
            regexp_replace(regexp_replace(regexp_replace(regexp_replace(before, '(https?://)[^/\s@]+@', '\1', 'g'), '(https?://[^\s?#]+)[?#]\S*', '\1', 'g'),
                '(?i)\b(password|passwd|secret|token|api_?key)\b(\s*[:=]\s*)\S+', '\1\2[REDACTED]', 'g'), '(^|[\s(])/(?:home|root|Users|var|etc)/\S+', '\1[PATH]', 'g') AS after FROM r)
        SELECT id, sha256(after) AS sha256, length(before) - length(after) AS shorter FROM a WHERE before <> after
    """,
    "clock_fields": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS at, 86400 - floor(epoch(ts))::BIGINT % 86400 AS to_midnight FROM events",
    "schedules": """
        SELECT e AS epoch, round(CASE WHEN e <= 5 THEN 1e-3 * (0.1 + 0.9 * (e - 1) / 4.0::DOUBLE) ELSE 1e-5 + (1e-3 - 1e-5) * 0.5 * (1 + cos(pi() * (e - 5) / 95)) END, 9) AS rate,
               round(CASE WHEN e * 30 >= 2000 THEN 1.0 ELSE 0.5 * (1 - cos(pi() * e * 30 / 2000)) END, 9) AS ramp, floor(e / 8.0::DOUBLE + 0.5)::BIGINT AS eighths FROM range(1, 101) t(e)
    """,
    "registry_check": """
        SELECT event_type, array_to_string(list_sort(json_keys(props)), ',') AS keys, count(*) AS n, event_type IN ('view', 'click', 'purchase') AS known FROM events GROUP BY 1, 2
    """,
    "daily_budget": f"""
        WITH {_EVENTS}, r AS (SELECT event_id, event_type, seconds, seconds // 86400 AS day, 60 + event_id % 7 * 60 AS cost FROM e),
        p AS (SELECT *, count(*) FILTER (event_type <> 'error') OVER w AS place, sum(cost) FILTER (event_type <> 'error') OVER w AS reserved FROM r WINDOW w AS (PARTITION BY day ORDER BY seconds, event_id)),
        q AS (SELECT event_id, day, CASE WHEN event_type = 'error' THEN 'closed' WHEN place > 20 THEN 'count' WHEN reserved > 3600 THEN 'seconds' END AS reason FROM p)
        SELECT event_id, day, reason IS NULL AS admitted, reason FROM q
    """,
    "idempotency_conflicts": """
        WITH r AS (SELECT user_id || '/' || event_type AS key, sha256(props) AS digest, event_id FROM events)
        SELECT key, count(*) AS n, count(DISTINCT digest) AS digests, arg_min(digest, event_id) AS first, min(event_id) AS job, count(DISTINCT digest) > 1 AS conflict FROM r GROUP BY 1
    """,
    "bounded_admission": f"""
        WITH {_EVENTS}, w AS (SELECT event_type, count(*) OVER (PARTITION BY user_id ORDER BY seconds RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) - 1 AS others FROM e)
        SELECT event_type, count(*) FILTER (others < 2) AS taken, count(*) FILTER (others >= 2) AS refused, max(others) AS most FROM w GROUP BY 1
    """,
    "token_bucket": f"""
        WITH RECURSIVE {_EVENTS}, r AS (SELECT user_id, event_id, seconds, row_number() OVER (PARTITION BY user_id ORDER BY seconds, event_id) AS n FROM e),
        walk(user_id, event_id, n, moment, tokens, admitted, retry_after) AS (
            SELECT user_id, event_id, n, seconds, 1.0::DOUBLE, true, 0::BIGINT FROM r WHERE n = 1
            UNION ALL
            SELECT user_id, event_id, n, seconds, CASE WHEN t >= 1 - 1e-9 THEN t - 1 ELSE t END, t >= 1 - 1e-9, CASE WHEN t >= 1 - 1e-9 THEN 0 ELSE ceil((1 - t) * 86400 / 2 - 1e-9)::BIGINT END
            FROM (SELECT r.user_id, r.event_id, r.n, r.seconds, least(2.0::DOUBLE, w.tokens + (r.seconds - w.moment) * 2 / 86400.0::DOUBLE) AS t FROM walk w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1))
        SELECT user_id, event_id, admitted, retry_after FROM walk
    """,
    "lease_replay": f"{_LEASES} SELECT user_id AS case_id, event_id AS sequence, result, state, attempt, codes AS failure_codes FROM walk WHERE n > 0",
    "sweep_rollup": f"""
        {_LEASES}, last AS (SELECT * FROM walk WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
        SELECT state, 'cases' AS what, count(*) AS n FROM last GROUP BY 1 UNION ALL SELECT state, 'retries', sum(greatest(0, attempt - 1))::BIGINT FROM last GROUP BY 1
        UNION ALL SELECT state, code, count(*) FROM (SELECT state, unnest(string_split(codes, ',')) AS code FROM last) WHERE code <> '' GROUP BY 1, 2
    """,
    "readiness": "SELECT CASE WHEN s_acctbal < 0 THEN 'overdrawn' WHEN s_nationkey > 20 THEN 'far' WHEN s_acctbal < 2000 THEN 'poor' ELSE 'ready' END AS reason, count(*) AS n FROM supplier GROUP BY 1",
    "exact_quantiles": """
        SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.01), 4) AS q01, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.995), 4) AS q995
        FROM lineitem GROUP BY 1, 2
    """,
    "bootstrap_median_interval": f"""
        WITH drawn AS (
            SELECT s_nationkey, s_suppkey, s_acctbal AS v, r, ('0x' || md5('17|' || s_suppkey || '|' || (r // 4))[(r % 4) * 8 + 1:(r % 4) * 8 + 8])::BIGINT AS b FROM supplier, range(200) t(r)
        ), w AS (SELECT *, {" + ".join(f"(b >= {t})::INT" for t in POISSON)} AS w FROM drawn),
        c AS (SELECT *, sum(w) OVER (PARTITION BY s_nationkey, r ORDER BY v, s_suppkey) AS e, sum(w) OVER (PARTITION BY s_nationkey, r) AS a FROM w),
        m AS (SELECT s_nationkey, r, (max(v) FILTER (e - w <= (a - 1) // 2 AND (a - 1) // 2 < e) + max(v) FILTER (e - w <= a // 2 AND a // 2 < e)) / 2 AS m FROM c WHERE w > 0 GROUP BY 1, 2)
        SELECT s_nationkey, (SELECT count(s_acctbal) FROM supplier s WHERE s.s_nationkey = m.s_nationkey) AS n, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high
        FROM m GROUP BY 1
    """,
}
