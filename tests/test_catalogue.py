"""Every query with a SQL twin gives the same rows as DuckDB; what the others must give is told in test_whole_input and test_planes."""

import pytest
from compare import rows_of

from fringeworks.plans.catalogue import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, duck, sf_dir):
    got, want = rows_of(QUERIES[name](spark, sf_dir).toPandas()), rows_of(duck.sql(SQL[name]).df())
    assert got == want
