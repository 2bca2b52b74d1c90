import pytest

from depguard.llm.queries import QUERIES, SQL
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    if name in SQL:
        same(df, SQL[name], small)
    else:
        assert df.count() > 0


COLUMNS = {"p1_found": [("rep_id", "bigint"), ("id", "bigint")], "p3_found": [("entry_id", "bigint"), ("ref_id", "bigint")], "p5_found": [("rec_id", "bigint"), ("group_id", "bigint")], "p8_found": [("doc_id", "bigint"), ("item_id", "bigint")], "p9_found": [("doc_id", "bigint")]}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, small, name):
    assert QUERIES[name](spark, small).dtypes == COLUMNS[name]
