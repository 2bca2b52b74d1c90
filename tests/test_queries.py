import pytest

from depguard.queries import cleaning, rules
from tests.oracle import same

QUERIES, SQL = {**rules.QUERIES, **cleaning.QUERIES}, {**rules.SQL, **cleaning.SQL}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    if name in SQL:
        same(df, SQL[name], small)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
