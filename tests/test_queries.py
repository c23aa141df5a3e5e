"""Every registered query against its SQL, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import difference, oracle  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_its_sql(spark, duck, name):
    result = entry.queries()[name](spark, FOLDER)
    if name in SQL:
        assert difference(result, duck.sql(SQL[name])) is None
    else:
        assert result.count() > 0


def test_entry_finds_unusual_days(spark):
    found = entry.entry(spark)
    assert set(found.columns) == {"user_id", "day", "score", "tau", "margin", "tau_from", "role", "rank"}
    assert found.count() > 0 and found.filter("margin <= 0").count() == 0
