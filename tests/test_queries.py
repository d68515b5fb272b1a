"""Every query with SQL against that SQL, on the smallest tables."""

import pytest
from oracle import assert_same

from tessera.plans.registry import QUERIES, SQL


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    assert_same(spark, sf_dir, QUERIES[name], SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
