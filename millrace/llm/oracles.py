"""SQL for DuckDB that gives the rows of the later queries of this subpackage."""

from __future__ import annotations


def vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
        assigned{k} AS (
            SELECT d.p, d.part, any_value(d.n) AS n,
                   min(list_sum(list_transform(range(1, len(d.part) + 1), lambda i: (d.part[i] - c.part[i]) * (d.part[i] - c.part[i]))) * {entries} + c.k) AS best
            FROM parts d JOIN books{k} c ON c.p = d.p GROUP BY d.p, d.part
        )""")
        if k < rounds:
            steps.append(f"""
        sums{k} AS (
            SELECT p, best % {entries} AS k, i, sum(part[i] * n) AS s, sum(n) AS n
            FROM (SELECT p, part, n, best, unnest(range(1, len(part) + 1)) AS i FROM assigned{k}) GROUP BY ALL
        ), means{k} AS (
            SELECT p, k, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY i) AS part FROM sums{k} GROUP BY p, k
        ), books{k + 1} AS (
            SELECT b.p, b.k, coalesce(m.part, b.part) AS part FROM books{k} b LEFT JOIN means{k} m ON m.p = b.p AND m.k = b.k
        )""")
    return f"""
        WITH kept AS (
            SELECT row_number() OVER () AS r, vec_id, label,
                   list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), cut AS (
            SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS part
            FROM (SELECT r, v, unnest(range(0, {parts})) AS p FROM kept)
        ), parts AS (
            SELECT p, part, count(*) AS n FROM cut GROUP BY p, part
        ), first AS (
            SELECT vec_id, min(r) AS r, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT {entries}
        ), books0 AS (
            SELECT c.p, f.k, c.part FROM first f JOIN cut c ON c.r = f.r
        ), {", ".join(s.strip() for s in steps)},
        digest AS (
            SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, k)) AS s FROM books{rounds}
        ), coded AS (
            SELECT c.r, string_agg(lower(lpad(to_hex(CAST(a.best % {entries} AS BIGINT)), 2, '0')), '' ORDER BY c.p) AS code, CAST(sum(a.best // {entries}) AS BIGINT) AS error
            FROM cut c JOIN assigned{rounds} a ON a.p = c.p AND a.part = c.part GROUP BY c.r
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest.s AS codebooks_sha256
        FROM kept JOIN coded USING (r), digest
    """


def _luhn(digits: str) -> str:
    d = f"(ascii({digits}[i]) - 48)"
    doubled = f"CASE WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END"
    return f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 1 THEN {doubled} ELSE {d} END)) % 10 = 0"


def _mod97(bare: str) -> str:
    codes = f"list_transform(string_split(concat({bare}[5:], {bare}[1:4]), ''), lambda c: CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
    return f"list_reduce(list_prepend(0, {codes}), lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) = 1"


def personal_data() -> str:
    """The kinds of pii.py as plain patterns: this engine's search is linear as it is."""
    digits, bare = "regexp_replace(m, '[^0-9]', '', 'g')", "replace(m, ' ', '')"
    byte = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    phone_words = "phone|tel|call|mobile|fax|cell"
    card = r"[0-9](?:[\x20-]?[0-9])+"
    # Name, pattern, what is valid, score, words near and what they add, words against and what they take, least score.
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 90, "e-?mail|contact|write", 10, "", 0, 0),
        ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", rf"regexp_full_match(m, '{byte}(\.{byte}){{3}}')", 60, "ip|address|host|server|login", 30, "version|release|build|section", 40, 0),
        ("card", card, f"CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN {_luhn(digits)} ELSE false END", 80, "card|visa|credit|payment", 20, "order|invoice|tracking|serial", 30, 0),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 8 AND 15", 60, phone_words, 30, "", 0, 0),
        ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", f"CASE WHEN length({bare}) BETWEEN 15 AND 34 THEN {_mod97(bare)} ELSE false END", 80, "iban|account|bank", 20, "", 0, 0),
        ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')", 30, "ssn|social security", 50, "", 0, 50),
        ("localphone", r"\b[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\b", r"NOT regexp_matches(before, '\+[0-9 ().-]*$')", 30, phone_words, 40, "", 0, 50),
        ("shortcard", card, f"CASE WHEN length({digits}) BETWEEN 13 AND 15 THEN {_luhn(digits)} ELSE false END", 40, "card|visa|credit|payment|amex", 30, "", 0, 50),
    ]
    found = []
    for no, (name, pattern, valid, score, near, adds, against, takes, least) in enumerate(kinds):
        less = f" - CASE WHEN regexp_matches(before, '{against}') THEN {takes} ELSE 0 END" if against else ""
        found.append(f"""
            SELECT r, {no} AS no, '{name}' AS kind, start, start + length(m) AS stop, score
            FROM (SELECT *, least(100, {score} + CASE WHEN regexp_matches(before, '{near}') THEN {adds} ELSE 0 END{less}) AS score FROM (
                SELECT r, m, lower(right(gap, 40)) AS before, sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i) - length(m) AS start
                FROM (SELECT r, i, g[i] AS gap, f[i] AS m FROM (
                    SELECT r, g, f, unnest(range(1, len(f) + 1)) AS i
                    FROM (SELECT r, string_split_regex(body, '{pattern}') AS g, regexp_extract_all(body, '{pattern}') AS f FROM texts)
                ))
            )) WHERE ({valid}) AND score >= {least}""")
    counts = ", ".join(f"count(f.r) FILTER (WHERE kind = '{k[0]}') AS n_{k[0]}" for k in kinds[:4])
    each = "kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR)"
    return f"""
        WITH texts AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents
        ), found AS ({" UNION ALL ".join(found)})
        SELECT any_value(doc_id) AS doc_id, {counts},
               sha256(coalesce(string_agg({each}, ',' ORDER BY no, start) FILTER (WHERE no < 4), '')) AS base_sha256,
               coalesce(string_agg({each}, ',' ORDER BY no, start), '') AS spans,
               coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY no, start), '') AS scores
        FROM texts t LEFT JOIN found f ON f.r = t.r GROUP BY t.r
    """


def prefix_trie() -> str:
    bits = "flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST({bits} AS BIGINT[])), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295)"
    return f"""
        WITH turns AS (
            SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(concat(strlen(role), ':', role, text))) AS pos
            FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
        ), known AS (
            SELECT conv_id, {crc} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)
        ), rebuilt AS (
            SELECT k.conv_id, t.pos, t.role, t.text FROM known k JOIN turns t ON t.conv_id = k.conv_id - k.conv_id % 100 AND t.pos <= k.h
            UNION ALL
            SELECT k.conv_id, t.pos, t.role, t.text FROM known k JOIN turns t ON t.conv_id = k.conv_id AND t.pos > k.h
        ), placed AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d, length(text) AS n, sha256(concat(strlen(role), ':', role, text)) AS t FROM rebuilt
        ), lists AS (
            SELECT k.conv_id, coalesce(list(t ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS ts, coalesce(list(n ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS ns
            FROM known k LEFT JOIN placed p ON p.conv_id = k.conv_id GROUP BY k.conv_id
        ), steps AS (
            SELECT conv_id, d, len(ts) = d AS ends, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n,
                   sha256(array_to_string(ts[1:d], ' ')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(ts[1:d - 1], ' ')) END AS up
            FROM (SELECT conv_id, ts, ns, unnest(range(0, len(ts) + 1)) AS d FROM lists)
        ), nodes AS (
            SELECT k, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
            FROM steps GROUP BY k
        ), children AS (
            SELECT up AS k, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up
        ), under AS (
            SELECT DISTINCT a.k AS top, b.k AS k FROM steps a JOIN steps b ON b.conv_id = a.conv_id AND b.d >= a.d
        ), sums AS (
            SELECT top, sum(CAST(c.n_children IS NULL AS BIGINT)) AS n_leaves, sum((o.n_convs - 1) * o.n) AS saved
            FROM under u JOIN nodes o ON o.k = u.k LEFT JOIN children c ON c.k = u.k GROUP BY top
        )
        SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, coalesce(c.n_children, 0) AS n_children,
               CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, o.ends_sha256
        FROM nodes o JOIN sums s ON s.top = o.k LEFT JOIN children c ON c.k = o.k LEFT JOIN nodes p ON p.k = o.up
    """
