import pytest

from tests import compare
from tidemark.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    got = registry.queries()[name](spark, sf).toPandas()
    want = compare.connection(sf).execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.rows(got) == compare.rows(want)
