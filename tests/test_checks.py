"""Every query with check SQL gives the same rows on DuckDB."""

import pytest

import __spark_entry__ as entry_module
import check
from tests.conftest import SMALL

SQL = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    text, fine = check.compare(spark, duck, SMALL, name, entry_module.queries()[name], SQL[name])
    assert fine, text


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert "visits_30days" in df.columns
