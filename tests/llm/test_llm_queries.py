"""The queries that SQL can express, against DuckDB on the smallest driver tables; and the entry module."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as E
from cohortlens.llm import queries as Q

PATH = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{PATH}/{t}.parquet')")
    df = Q.queries()[name](spark, PATH)
    want = con.sql(Q.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    rows = want.fetchall()
    assert sorted(tuple(r[c] for c in order) for r in df.collect()) == sorted(tuple(r[want.columns.index(c)] for c in order) for r in rows)


def test_entry_registers_one_query_for_each_operator_and_the_pipeline():
    names = [n for n in E.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert "pipeline" in E.queries() and set(Q.oracle_sql()) <= set(E.oracle_sql())


def test_entry_works_without_the_operators(monkeypatch):
    import importlib

    for gone in ("cohortlens.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, gone, None)  # importing it now raises ModuleNotFoundError
    try:
        entry = importlib.reload(E)
        assert not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
        assert "q05_posts_per_user_cohort_time" in entry.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(E)
    assert "pipeline" in E.queries()


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(Q.__file__)))
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert "cohortlens.llm" not in open(os.path.join(folder, f)).read(), f
