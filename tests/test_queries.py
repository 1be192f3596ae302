import pytest
from oracle_check import DIRECTORY, same_rows

from pruefwerk.plans import ORACLE, QUERIES

pytestmark = pytest.mark.skipif(not DIRECTORY.exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    same_rows(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DIRECTORY)).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE) <= set(__spark_entry__.queries())
