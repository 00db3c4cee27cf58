"""The newer queries of this subpackage against their SQL."""

import os

import duckdb
import pytest

from millrace.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def other(sf_dir):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, other, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    said = other.execute(SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted((tuple(r) for r in said.fetchall()), key=str)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == rows


def test_every_dealt_operator_has_a_query():
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, len(QUERIES) + 1))
