"""Registered queries beside their SQL on the smallest tables, and the streams beside the batch results."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from quire.plans import catalog
from tools.compare import rows_of

NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="session")
def db(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for path in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, data, db, name):
    frame = catalog.queries()[name](spark, data)
    rel = db.sql(catalog.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(rel.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(rel.columns, rel.fetchall())


def test_streamed_throttle_equals_batch(spark, data):
    queries = catalog.queries()
    streamed, batch = (sorted(map(tuple, queries[q](spark, data).collect())) for q in ("stream_throttle", "throttled_events"))
    assert streamed == batch and streamed


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(NAMES)))
def test_query_without_sql_gives_rows(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
