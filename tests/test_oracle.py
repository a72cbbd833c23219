"""Every registered query with a SQL twin equals DuckDB's answer on sf0.001 (bag of rows)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, con, name):
    ok, msg = compare(spark, SF, name, entry.queries()[name], entry.oracle_sql()[name], con)
    assert ok, msg


def test_every_query_has_a_callable_and_sql_keys_exist():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 100


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "month", "income", "expense"]
    assert df.count() > 0
