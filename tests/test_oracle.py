"""Every registered query with SQL gives what DuckDB gives; the library works without its llm subpackage."""

import decimal
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import plans

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(rows):
    return sorted((tuple(float(x) if isinstance(x, decimal.Decimal) else x for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, sf, name):
    df = plans.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    if name not in plans.oracle_sql():
        assert got
        return
    want = duck.sql(plans.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert got == plain(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_llm():
    code = "import sys; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'scan_aggregate' in q and not [x for x in q if x.startswith('op') and x[2].isdigit()] and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
