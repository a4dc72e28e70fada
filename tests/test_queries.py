"""Every query with SQL gives DuckDB's rows at the small size; every other one runs."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyloom.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(frame):
    def cell(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool):
            return str(v)
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    cols = sorted(frame.columns)
    clean = frame[cols].astype(object).where(frame[cols].notna(), None)
    return cols, sorted(repr([cell(v) for v in r]) for r in clean.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert rows(got) == rows(duck.sql(catalogue.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries())
