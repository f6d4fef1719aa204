import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import difference

SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_its_sql(spark, name):
    problem, n, _ = difference(spark, SMALL, name)
    assert problem is None
    assert n > 0


def test_entry(spark):
    assert entry(spark).columns == ["user_id", "rank", "item_id", "title", "prediction", "link", "image_link"]
