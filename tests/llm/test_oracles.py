"""Queries against their SQL."""

import duckdb
import pytest

from rateloom.llm import catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(catalog.ORACLE_SQL[name])
    found = catalog.QUERIES[name](spark, SF).select(*want.columns)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted((tuple(r) for r in want.fetchall()), key=str)
