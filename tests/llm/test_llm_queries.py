import pytest

from memlattice.llm import queries


@pytest.mark.parametrize("name", queries.ORACLE)
def test_query_equals_sql(name, same):
    same(name, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE])
def test_query_runs(name, spark):
    from conftest import DATA

    assert queries.QUERIES[name](spark, DATA).count() > 0
