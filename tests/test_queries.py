"""Every registered query of the library runs on the smallest tables and agrees with its SQL."""

import glob
import os

import duckdb
import pytest

from pagequarry.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in ([str(x) if not isinstance(x, float) else x for x in r] for r in data))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = con.execute(registry.oracles()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["site", "theme", "mentions", "examples", "place"]
    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
