"""Every registered catalogue query that SQL can state, against DuckDB."""

import pytest

from shelfspark.plans import queries
from tests.oracle import SMALL, assert_same, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    assert_same(queries.QUERIES[name](spark, SMALL), con.execute(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() >= 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "book_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())
