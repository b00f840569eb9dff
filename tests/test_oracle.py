import pytest

from tidemark import catalogue

from . import compare


@pytest.fixture(scope="module")
def duck(sf):
    return compare.connection(sf)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    got = catalogue.queries()[name](spark, sf).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.rows(got) == compare.rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, sf, name):
    got = catalogue.queries()[name](spark, sf)
    assert len({c.lower() for c in got.columns}) == len(got.columns) and got.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
