"""Every registered query at the smallest scale: against its SQL where it has one, else for rows."""

import os

import pytest

import check_oracle
from cohortry.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert check_oracle.compare(con, df, ORACLES[name]) == ""
    else:
        assert df.collect()


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).columns == ["feat1", "feat2", "abs_rho"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
