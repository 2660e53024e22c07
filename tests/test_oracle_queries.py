"""Every registered query with oracle SQL matches DuckDB at sf0.01; rows-only queries run."""

import pytest

import __spark_entry__ as E
from oracle import compare, duck

SF = "/root/testdata/sf0.01"
SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, con, name):
    ok, msg = compare(spark, con, SF, name, QUERIES[name], SQL[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["sequence_label", "n_sequences"]


def test_every_query_registered_has_doc():
    from packetlens.plans.registry import REGISTRY
    assert all(q.doc for q in REGISTRY.values())
