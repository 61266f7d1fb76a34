"""Every registered query against its DuckDB oracle on the smallest tables:
same columns, same types, same rows (order-insensitive)."""

import pytest

import __spark_entry__ as E
from tests.oracle_compare import compare, duck

NAMES = sorted(E.oracle_sql())  # the learned-model queries are checked in test_models.py


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, small_dir, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], small_dir)
    assert r["ok"], r
    assert "types" not in r, r


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) >= {"label"}
    assert df.count() > 0
