"""Every review query against its SQL equivalent; none may be empty on both of the smaller tables."""

import pytest

from riftline.jobs import queries as review
from tests.compare import connect, same

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(review.ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    if not same(review.QUERIES[name](spark, SF), review.ORACLE[name], duck):  # too few rows for a case in a hundred
        assert same(review.QUERIES[name](spark, MORE), review.ORACLE[name], connect(MORE))


@pytest.mark.parametrize("name", sorted(set(review.QUERIES) - set(review.ORACLE)))
def test_other_queries_return_rows(spark, name):
    assert review.QUERIES[name](spark, SF).count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count()
    assert set(entry.oracle_sql()) <= set(entry.queries())
