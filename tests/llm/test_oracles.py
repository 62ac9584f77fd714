"""The queries that SQL can express, against DuckDB."""

import pytest
from canon import canonical

from doclattice.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf_dir, duck, name):
    got = canonical(queries.queries()[name](spark, sf_dir).toPandas())
    assert got == canonical(duck.execute(queries.oracle_sql()[name]).df())
