"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from recallspark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows(values):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in v) for v in values), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    want = db.sql(catalog.ORACLES[name])
    columns = sorted(want.columns)
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert rows(got.select(*columns).collect()) == rows(want.select(*columns).fetchall())


def test_entry_without_the_llm_package(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "query_id"
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
