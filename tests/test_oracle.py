import pytest

from crestline import oracle, queries
from tests.conftest import same_rows


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_matches_sql(spark, sf, duck, name):
    same_rows(queries.queries()[name](spark, sf), duck, oracle.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())
