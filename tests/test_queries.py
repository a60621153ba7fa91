"""Every query with SQL against DuckDB; the others run and give rows."""

import pytest
from conftest import SF, duck, rows

from twinloom.plans.queries import SQL, Q


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    found, expected = Q[name](spark, SF).toPandas(), duck(SQL[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert len(found) and rows(found) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_gives_rows(spark, name):
    assert Q[name](spark, SF).count() > 0
