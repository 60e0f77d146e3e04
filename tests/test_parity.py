"""Every query against DuckDB."""

import pytest

from quillfin.plans import ORACLES, QUERIES
from tests.parity import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns, rows = duck_rows(con, ORACLES[name])
    assert sorted(df.columns) == columns
    assert spark_rows(df) == rows


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
