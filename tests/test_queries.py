"""Every query against its SQL on the smallest tables; those without SQL run and keep their schema."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from loresmith.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, DIR)
    found = [tuple(r) for r in df.collect()]
    if name not in catalogue.ORACLES:
        assert found or name == "rule_extraction"
        return
    want = db.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, found) == rows(want.columns, want.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["canonical", "n_docs", "total_chars"] and 0 < df.count() <= 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
