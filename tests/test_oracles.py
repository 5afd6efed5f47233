"""Spark vs DuckDB on the smallest data set for every registered query that has a SQL twin."""

import duckdb
import pytest

import __spark_entry__ as E
from fairband.plans.registry import ORACLE, QUERIES, load_all
from tools.oracle_check import TABLES, _rows

load_all()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    rel = con.execute(ORACLE[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, rel.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "status" in df.columns
