"""Every query of the catalogue against its SQL."""

import pytest

from gridspark.plans import catalogue
from tests.compare import duck, duck_rows, spark_rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    assert spark_rows(catalogue.QUERIES[name](spark, SF)) == duck_rows(duck(SF), catalogue.SQL[name])


def test_rows_only_queries(spark):
    rows = catalogue.greedy_placement(spark, SF).collect()
    assert len({r["cell_id"] for r in rows}) == 3
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert catalogue.gp_predict(spark, SF).where("std >= 0").count() == 25 * 30
