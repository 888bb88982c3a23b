"""Every registered query against its SQL, on the smallest data folder."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, canon

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for table in TABLES:
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        cur = con.execute(ORACLES[name])
        assert got == canon([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["store", "rows_erased", "rows_nulled", "rows_blocked", "rows_left"]
    assert df.count() == 6
