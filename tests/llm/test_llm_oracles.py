"""The llm queries that have SQL against DuckDB, on the smallest tables."""

import pytest

from lumicat.llm import queries
from tests.test_oracles import as_rows, duck  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, sf_dir, name):  # noqa: F811
    found = queries.QUERIES[name](spark, sf_dir)
    wanted = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert as_rows(found.columns, found.collect()) == as_rows(columns, wanted.fetchall())
