"""Every named query of the reference operators against its SQL twin, on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from dayspans.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, registry.QUERIES[name], registry.ORACLE[name], DATA) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).columns


@pytest.mark.parametrize("gone", [["corpus_pipeline"], ["dayspans.llm", "dayspans.llm.queries"], ["corpus_pipeline", "dayspans.llm", "dayspans.llm.queries"]])
def test_entry_imports_without_the_training_data_queries(monkeypatch, gone):
    import sys

    import __spark_entry__ as e

    for name in gone:
        monkeypatch.setitem(sys.modules, name, None)
    left = set(e.queries())
    assert set(registry.QUERIES) <= left and "pipeline" not in left
    if len(gone) > 1:
        assert left == set(registry.QUERIES) and set(e.oracle_sql()) == set(registry.ORACLE)
