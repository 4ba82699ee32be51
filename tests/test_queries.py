"""Every query of the engine against its SQL at the small scale."""

import datetime
import math

import duckdb
import pytest

from rateloom import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=str)
    assert got or name in ("anti_dropped_notes",)
    if name in catalog.ORACLE_SQL:
        rel = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(rel.columns) == cols
        want = sorted((tuple(plain(v) for v in r) for r in rel.select(*(f'"{c}"' for c in cols)).fetchall()), key=str)
        assert len(got) == len(want)
        assert [g for g, w in zip(got, want) if g != w] == [] or got == want, [(g, w) for g, w in zip(got, want) if g != w][:5]
