"""Every registered query against its SQL on the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from newsignal.contract import registry

DATA = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    cursor = db.execute(entry.oracle_sql()[name])
    columns = sorted(c[0] for c in cursor.description)
    assert sorted(df.columns) == columns
    order = [[c[0] for c in cursor.description].index(c) for c in columns]
    expected = sorted(repr([row[i] for i in order]) for row in cursor.fetchall())
    assert sorted(repr([row[c] for c in columns]) for row in df.collect()) == expected
