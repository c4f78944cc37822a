"""Every registered core query against DuckDB, or at least that it runs."""

import pytest
from oracle import assert_same

from tabulon.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, folder, name):
    assert_same(QUERIES[name](spark, folder), ORACLES[name], folder)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert [r.n for r in e.entry(spark).orderBy("bin").collect()] == [1468, 1165, 1229, 1243, 895]
    assert set(e.oracle_sql()) <= set(e.queries())
