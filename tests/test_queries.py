"""Every registered query against its SQL twin; the rest must give rows."""

import pytest

import harness
from fluxline.queries import load

REGISTRY = load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return harness.duck(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY.QUERIES))
def test_query(spark, con, name):
    df = REGISTRY.QUERIES[name](spark, SF)
    if name in REGISTRY.ORACLES:
        assert harness.difference(df, con, REGISTRY.ORACLES[name]) is None
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
