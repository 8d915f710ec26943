"""Queries that have SQL against it."""

import pytest

from gridspark.llm.queries import oracle_sql, queries
from tests.compare import duck, duck_rows, spark_rows


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    assert spark_rows(queries()[name](spark, folder)) == duck_rows(duck(folder), oracle_sql()[name])
