"""All queries on the driver tables and their SQL."""

from __future__ import annotations

from millrace.plans import edges, evidence, networks, queries, sql, state

QUERIES = queries.QUERIES | evidence.QUERIES | state.QUERIES | edges.QUERIES | networks.QUERIES
SQL = sql.SQL | evidence.SQL | state.SQL | edges.SQL | networks.SQL
