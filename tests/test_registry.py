"""Every registered query with SQL against DuckDB on the smallest data, where that is present."""

import os
import sys
from pathlib import Path

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402
from verify import normal  # noqa: E402

DATA = Path(os.environ.get("LODEGRAPH_TEST_DATA", "/root/testdata/sf0.001"))
SQL = entry.oracle_sql()


def test_names():
    assert SQL.keys() <= entry.queries().keys()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, str(DATA)).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
