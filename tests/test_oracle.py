"""Every query with SQL returns the same rows from both engines."""

import os

import pytest
from check import compare, duck

import __spark_entry__ as entry

FOLDER = f"/root/testdata/sf{os.environ.get('ORACLE_SF', '0.001')}"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, connection, name):
    assert compare(entry.queries()[name](spark, FOLDER), connection, ORACLES[name]) is None


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["stream", "time", "n_risk", "n_event", "n_censor", "surv"]
