"""Every query with an oracle equals it on the smallest tables."""

from __future__ import annotations

import pytest

import catalog
from catalog.compare import compare, connect
from catalog.registry import ORACLES, QUERIES

catalog.load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, sf_dir, name):
    assert compare(spark, con, name, sf_dir) is None


def test_entry_points(spark):
    import __spark_entry__ as entry_module

    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(QUERIES) <= set(entry_module.queries())
    assert entry_module.entry(spark).columns == ["measure", "n", "pct"]
