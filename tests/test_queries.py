"""Every query with SQL beside it gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from assaywork.plans import catalog
from assaywork.sources.views import TABLES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(names).collect()]
    assert got
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == names
        at = [want.columns.index(c) for c in names]
        assert plain(got) == plain([tuple(r[i] for i in at) for r in want.fetchall()])
