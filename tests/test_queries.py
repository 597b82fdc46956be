"""Every query with SQL must equal it; the others must run and give rows."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

ORACLES = entry.oracle_sql()
# Searches of 40 fits and more are left to the tests of their parts and to tests/compare.py, which runs them over the larger tables.
SEARCHES = ("m5_grid", "m13_model", "m14", "m15", "m18", "x15")
# The optional operators have tests of their own in tests/llm.
OTHERS = [n for n in entry.queries() if n not in ORACLES and not n.startswith((*SEARCHES, "op", "pipeline"))]


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", list(ORACLES))
def test_equals_sql(spark, data, con, name):
    assert compare(spark, data, entry.queries()[name], ORACLES[name], con) is None


@pytest.mark.parametrize("name", OTHERS)
def test_gives_rows(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0


def test_names():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"sex", "rbg200", "count", "cumulative", "percent", "nursing"}
    assert df.count() > 0
