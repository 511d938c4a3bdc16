"""Every query with SQL must give the rows that DuckDB gives over the same files, by column name."""

import datetime as dt
import os
from decimal import Decimal

import duckdb
import pytest

from tidemill import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_oracle(spark, db, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = db.sql(registry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_without_oracle(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 30
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
