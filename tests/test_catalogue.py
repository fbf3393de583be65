"""Every catalogue query against DuckDB on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tracelake.plans.catalogue import CATALOGUE

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in CATALOGUE.items() if sql))
def test_same_as_sql(spark, sf, duck, name):
    query, sql = CATALOGUE[name]
    df = query(spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    rel = duck.sql(sql)
    at = [rel.columns.index(c) for c in names]
    assert sorted(rel.columns) == names
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
