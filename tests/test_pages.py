"""Pages are read by themselves, from their own files."""

import os

import pytest
from pyspark.sql import functions as F

from cohortlens.sources.pages import fetch_from, fetch_page, numbered_rows, page_index, save_pages


@pytest.fixture
def saved(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 10).alias("v")).repartition(5)
    save_pages(df, f"{tmp_path}/p", ["k"], 64, rows_per_file=200)
    return f"{tmp_path}/p"


def test_every_page_in_order(spark, saved):
    index = {r["_page"]: r for r in page_index(spark, saved).collect()}
    assert sorted(index) == list(range(16)) and [index[p]["n_rows"] for p in range(16)] == [64] * 15 + [40]
    for p in (0, 7, 15):
        got = [r["k"] for r in fetch_page(spark, saved, p).collect()]
        assert got == list(range(64 * p, min(1000, 64 * p + 64))) and index[p]["first_key"]["k"] == 64 * p
    assert fetch_page(spark, saved, 16).count() == 0 and fetch_page(spark, saved, 3).columns == ["k", "v"]


def test_a_fetch_goes_on_where_it_stopped(spark, saved):
    assert [r["k"] for page in fetch_from(spark, saved, 14) for r in page] == list(range(896, 1000))


def test_a_page_reads_only_its_files(spark, saved):
    every = {f for f in os.listdir(f"{saved}/rows") if f.endswith(".parquet")}
    assert len(every) > 2
    for p in (0, 9):
        used = {os.path.basename(f) for f in fetch_page(spark, saved, p).inputFiles()}
        assert used == {os.path.basename(f) for f in page_index(spark, saved).where(F.col("_page") == p).first()["files"]}
        assert len(used) < len(every)
        plan = fetch_page(spark, saved, p)._jdf.queryExecution().executedPlan().toString()
        assert f"EqualTo(_page,{p})" in plan.replace(" ", "")


def test_ties_nulls_and_nothing(spark, tmp_path):
    df = spark.createDataFrame([(None, 1), (None, 1), (2, 1), (2, 0), (1, 5)], "k int, v int").repartition(3)
    rows = [(r["_row"], r["k"]) for r in numbered_rows(df, ["k"]).orderBy("_row").collect()]
    assert rows == [(0, None), (1, None), (2, 1), (3, 2), (4, 2)]
    save_pages(df.where("false"), f"{tmp_path}/e", ["k"], 10)
    assert page_index(spark, f"{tmp_path}/e").count() == 0 and list(fetch_from(spark, f"{tmp_path}/e")) == []
    with pytest.raises(ValueError):
        save_pages(df, f"{tmp_path}/x", ["k"], 0)
