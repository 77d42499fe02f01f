import pytest
from oracle import DATA, connection, same

from fluxtrace.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    same(QUERIES[name](spark, DATA), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 31
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
