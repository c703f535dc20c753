import pytest

from groundlane.llm import queries

from ..compare import assert_same


@pytest.mark.parametrize("name", queries.SQL)
def test_query_equals_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.SQL[name])
