"""Whole tables against DuckDB: every link, component, hit and digest."""

import duckdb
import pytest

from tesserae.llm import queries, warc


@pytest.mark.parametrize("name,sf", [("op1_embed_dedup", "sf0.01"), ("op2_minhash", "sf0.01"), ("op3_mixing", "sf0.01"), ("op6_decontam", "sf0.01"), ("op7_warc", "sf0.01")])
def test_tables(spark, name, sf):
    at = f"/root/testdata/{sf}"
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        db.sql(f"create view {t} as select * from '{at}/{t}.parquet'")
    want = db.sql((queries.oracle_sql() | {"op7_warc": warc.SQL})[name])
    cols = sorted(want.columns)
    got = queries.queries()[name](spark, at)
    assert sorted(got.columns) == cols
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    rows = lambda rs: sorted(repr([plain(v) for v in r]) for r in rs)
    assert rows(got.select(*cols).collect()) == rows(want.project(", ".join(cols)).fetchall())
