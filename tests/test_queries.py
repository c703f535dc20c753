import pytest

from groundlane.plans import registry

from .compare import assert_same


@pytest.mark.parametrize("name", registry.SQL)
def test_query_equals_sql(spark, name):
    assert_same(spark, registry.QUERIES[name], registry.SQL[name])


def test_partitioning_changes_nothing(spark):
    name, rows = "q08_group_split", []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(tuple, registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1]
