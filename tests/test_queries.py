"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from check import TABLES, normal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "segment" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = entry_points.queries()[name](spark, SF).toArrow().to_pandas(types_mapper=pd.ArrowDtype)
    want = con.execute(entry_points.oracle_sql()[name]).to_arrow_table().to_pandas(types_mapper=pd.ArrowDtype)
    assert sorted(got.columns) == sorted(want.columns)
    plain = [normal(p.astype(object).where(p.notna(), None)) for p in (got, want)]
    assert plain[0] == plain[1]
