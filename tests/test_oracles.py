"""Every registered query against its SQL on DuckDB, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from lumicat.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return str(value.normalize())
    return str(value) if isinstance(value, datetime.datetime) else value


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    wanted = duck.execute(ORACLE[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert as_rows(found.columns, found.collect()) == as_rows(columns, wanted.fetchall())


def test_without_sql(spark, sf_dir):
    """Queries that SQL can't express return rows of a stable schema."""
    for name in sorted(set(QUERIES) - set(ORACLE)):
        found = QUERIES[name](spark, sf_dir)
        assert found.columns and found.count() > 0, name
