"""Materialised tables of a run are removed with it."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from cohortlens.sources import materialize, save, scratch_path, scratch_run


def path_of(folder):
    return folder.removeprefix("file:")


def test_tables_of_a_run_go_and_saved_results_stay(spark, tmp_path):
    with scratch_run(spark, "study") as folder:
        df = materialize(spark.range(10).withColumn("m", F.col("id") % 3), "rows")
        assert os.listdir(path_of(folder)) and all(f"{os.path.basename(folder)}/rows-" in f for f in df.inputFiles())
        save(df.groupBy("m").count(), f"{tmp_path}/out")
    assert not os.path.exists(path_of(folder))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    assert folder not in scratch_path(spark, "later")


def test_a_failed_run_is_removed_too(spark):
    with pytest.raises(ZeroDivisionError):
        with scratch_run(spark) as folder:
            materialize(spark.range(3), "rows")
            1 / 0
    assert not os.path.exists(path_of(folder))
    assert folder not in scratch_path(spark, "later")


def test_nested_runs_remove_their_own(spark):
    with scratch_run(spark) as outer:
        kept = materialize(spark.range(4), "kept")
        with scratch_run(spark) as inner:
            assert inner.startswith(outer + "/")
            materialize(spark.range(5), "gone")
        assert not os.path.exists(path_of(inner)) and kept.count() == 4
    assert not os.path.exists(path_of(outer))


def test_threads_of_a_run_share_its_folder(spark):
    with scratch_run(spark) as folder:
        got = []
        threads = [threading.Thread(target=lambda: got.append(scratch_path(spark, "t"))) for _ in range(3)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert len(set(got)) == 3 and all(p.startswith(folder + "/") for p in got)


def test_a_run_without_tables(spark):
    with scratch_run(spark) as folder:
        pass
    assert not os.path.exists(path_of(folder))
