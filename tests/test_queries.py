"""Every query against its SQL, on the smallest tables."""

import pytest

from regspark.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, same, name):
    same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    """What they give is tested in the modules of their operators."""
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
