"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from cohortlens.plans.registry import queries
from tests.conftest import SMALL

TABLES = ("orders", "lineitem", "part")
NAMES = sorted(queries())  # those of the training-data operators have tests of their own


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SMALL, t)}.parquet')")
    return c


def _key(row):
    return tuple((0, "") if v is None else (1, round(v, 9)) if isinstance(v, float) else (2, str(v)) for v in row)


def _sorted(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(_key(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql()[name]
    rel = con.sql(sql)
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert _sorted(got, df.columns) == _sorted(want, rel.columns)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["x", "series", "y"]
    assert df.count() > 0
