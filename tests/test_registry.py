"""Every registered query against its SQL on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from cuesheet import registry

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in at) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF)
    done = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in done.description]
    assert sorted(got.columns) == sorted(columns)
    assert ordered(got.columns, got.collect()) == ordered(columns, done.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 150
