"""Every registered query runs; those with SQL equal DuckDB on the same tables."""

import pytest

from fieldgrain.plans import load_queries
from tools.check import compare, connect

QUERIES = load_queries()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    q = QUERIES[name]
    got = q.build(spark, sf_dir).toPandas()
    assert len(got.columns) > 0
    if q.sql:
        assert compare(got, duck.execute(q.sql).fetchdf()) == ""


def test_names_and_coverage():
    assert all(not n.startswith("op") for n in QUERIES)
    covered = {c for q in QUERIES.values() for c in q.covers.split()}
    assert {"P1", "G1", "W1", "K4", "D1", "T4", "M3", "ST2"} <= covered
