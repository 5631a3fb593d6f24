"""Every registered query against its independent DuckDB SQL."""

import os

import pytest

import __spark_entry__ as E
from tools.check_oracle import compare, duck
from wattspark.plans.oracle import ORACLE
from wattspark.plans.queries import QUERIES

SF = os.environ.get("WATTSPARK_TEST_SF", "/root/testdata/sf0.001")
NAMES = sorted(ORACLE)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE) <= set(E.oracle_sql())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["host", "energy_J", "energy_Wh", "energy_kWh"]
    assert df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    err = compare(df, con, E.oracle_sql()[name])
    assert err is None, err
