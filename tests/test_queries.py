"""Every query against its SQL on the smallest tables, and the driver's contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from docbraid.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        path = os.path.join(SF, name)
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def norm(df):
    cols = sorted(df.columns)
    return df[cols].astype(str).replace({"None": "nan", "<NA>": "nan", "NaN": "nan", "NaT": "nan"}).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    got, want = norm(queries.QUERIES[name](spark, SF).toPandas()), norm(con.sql(queries.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name in ("html_blocks", "html_chunks"):
        assert entry.queries()[name](spark, SF).count() > 0
