"""Every library query against its SQL, run by another engine on the same tables."""

import math
import os

import duckdb
import pytest

from millrace.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def other(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    yield con
    con.close()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6g}"
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, other, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    said = other.execute(SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(got.columns) == sorted(names)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(names, said.fetchall())


def test_all_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
