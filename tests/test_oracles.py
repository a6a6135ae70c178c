"""Every named query against its DuckDB oracle on the smallest driver tables."""

import os

import pytest
from compare import difference, duck_connection

from traceloom.plans.catalog import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
# need a few matching rows to say anything: checked at the next scale by tests/compare.py
SPARSE = {"snapshot_required", "context_budget", "event_page", "keyset_page", "time_travel"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    if name not in ORACLES:
        assert df.count() > 0
        return
    result = difference(df, con, ORACLES[name])
    assert result is None or (result == "EMPTY" and name in SPARSE), result


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
