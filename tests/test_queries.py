import pytest

from memlattice.plans import corpus, memory_queries, retrieval_queries, stream_queries

MODULES = (corpus, memory_queries, retrieval_queries, stream_queries)
WITH_SQL = [(n, m) for m in MODULES for n in m.ORACLE]
WITHOUT = [(n, m) for m in MODULES for n in m.QUERIES if n not in m.ORACLE]


@pytest.mark.parametrize("name,module", WITH_SQL, ids=[n for n, _ in WITH_SQL])
def test_query_equals_sql(name, module, same):
    same(name, module.QUERIES[name], module.ORACLE[name])


@pytest.mark.parametrize("name,module", WITHOUT, ids=[n for n, _ in WITHOUT])
def test_query_runs(name, module, spark):
    from conftest import DATA

    assert module.QUERIES[name](spark, DATA).count() >= 0


def test_entry_works_without_any_subpackage_missing():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
