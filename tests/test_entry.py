"""Every grid query runs at the smallest scale; those with SQL give DuckDB's results."""

import os

import pytest

import __spark_entry__ as entry
from trellis.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() == 16


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    a, b = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    a, b = (d[cols].sort_values(cols).reset_index(drop=True) for d in (a, b))
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE_SQL])
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
