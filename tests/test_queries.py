"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import glob
import math
import os

import pytest

from tesserae.plans import catalog

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(frame, cols):
    plain = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(x, 9) if isinstance(x, float) else x.tolist() if hasattr(x, "tolist") else x
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, db, sf, name):
    got = catalog.queries()[name](spark, sf).toPandas()
    assert len(got)
    if name in catalog.oracle_sql():
        want = db.sql(catalog.oracle_sql()[name]).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        assert rows(got, cols) == rows(want, cols)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
