"""Every timeline query against its SQL, on whole tables."""

import pytest

import oracle
from frameline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, con, name):
    assert not oracle.compare(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], con)


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLE_SQL.keys()))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["clip_id", "n_frames", "speaking_frames", "n_runs"]
    assert entry.oracle_sql().keys() <= entry.queries().keys()
