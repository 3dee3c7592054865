"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from corveil.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def views():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return db


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v if isinstance(v, (int, str, bool, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, views, name):
    df = driver.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name in catalog.SQL:
        found = views.sql(driver.oracle_sql()[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        want = [tuple(plain(r[k]) for k in at) for r in found.fetchall()]
        key = lambda r: tuple((v is not None, type(v).__name__ if isinstance(v, str) else "", v) for v in r)
        rows, want = sorted(rows, key=key), sorted(want, key=key)
        assert len(rows) == len(want)
        for a, b in zip(rows, want, strict=True):
            assert a == pytest.approx(b, rel=1e-4, abs=1e-4) if all(isinstance(x, (int, float)) for x in a + b) else all(x == pytest.approx(y, rel=1e-4, abs=1e-4) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b, strict=True))


def test_entry(spark):
    assert driver.entry(spark).count() > 0
