import pytest
from conftest import DATA, same_rows

from curvesmith import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(catalog.QUERIES[name](spark, DATA), duck.sql(catalog.SQL[name]))


def test_calibration_lookup(spark):
    rows = catalog.QUERIES["calibration_lookup"](spark, DATA).collect()
    assert rows and all(0 <= r.calibrated <= 1 for r in rows)


def test_search_is_seeded(spark):
    a = sorted(catalog.QUERIES["evolve_islands"](spark, DATA).collect())
    b = sorted(catalog.QUERIES["evolve_islands"](spark, DATA).collect())
    assert a == b and a


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
