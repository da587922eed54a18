"""Every query against its SQL twin in a second engine, value by value."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "orders", "lineitem", "documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_every_job_has_a_twin():
    assert set(entry.JOBS) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    ours = entry.queries()[name](spark, SF_DIR)
    twin = duck.execute(entry.oracle_sql()[name])
    columns = sorted(c[0] for c in twin.description)
    assert sorted(ours.columns) == columns
    at = [[c[0] for c in twin.description].index(c) for c in columns]
    expected = sorted(repr(tuple(r[i] for i in at)) for r in twin.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in ours.collect()) == expected


def test_entry_runs(spark):
    assert len(entry.entry(spark).take(1)) == 1
