"""Threshold distinct counts: exact up to n, sketched above, merged from stored states."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators.distinct import distinct_count, distinct_states, is_exact, merged_states, relative_error
from tests.conftest import rows


@pytest.fixture(scope="module")
def log(spark):
    """Group g has g * 40 values, each three times, and some NULLs; group 0 has NULLs alone; the NULL group has ten values."""
    full = spark.range(12 * 3 * 480).select((F.col("id") % 12).alias("g"), (F.floor(F.col("id") / 12) % 480).alias("v"))
    full = full.where("v < g * 40").select("g", F.when(F.col("v") % 479 == 478, None).otherwise(F.concat(F.lit("v"), "v")).alias("v"))
    extra = spark.range(60).select(F.when(F.col("id") < 20, F.lit(0)).cast("long").alias("g"), F.when(F.col("id") >= 20, F.concat(F.lit("n"), F.col("id") % 10)).alias("v"))
    return full.unionByName(extra).cache()


def test_exact_up_to_n_and_near_above(log):
    n = 200
    states = distinct_states(log, ["g"], "v", n)
    truth = {r["g"]: r["k"] for r in log.groupBy("g").agg(F.countDistinct("v").alias("k")).collect()}
    got = {r["g"]: r for r in states.select("g", is_exact().alias("exact"), distinct_count().alias("k"), F.size("members").alias("held")).collect()}
    assert set(got) == set(truth) == {None, *range(12)} and truth[0] == 0 and truth[None] == 10 and truth[5] == 200
    for g, k in truth.items():
        assert got[g]["exact"] == (k <= n) and (not got[g]["exact"] or got[g]["held"] == k)
        assert abs(got[g]["k"] - k) <= (0 if k <= n else 3 * relative_error() * k)


def test_merging_reads_states_only(spark, log, tmp_path):
    """States of halves, written and read back, give the states of the whole."""
    halves = log.withColumn("half", F.pmod(F.xxhash64("v"), F.lit(3)))
    distinct_states(halves, ["g", "half"], "v", 200).write.parquet(f"{tmp_path}/states")
    merged = merged_states(spark.read.parquet(f"{tmp_path}/states"), ["g"], 200)
    whole = distinct_states(log, ["g"], "v", 200)
    sets = lambda df: rows(df.select("g", F.array_join(F.array_sort("members"), ",").alias("m")), "g", "m")
    assert sets(merged) == sets(whole)
    both = merged.select("g", distinct_count().alias("a")).join(whole.select(F.col("g").alias("h"), distinct_count().alias("b")), F.col("g").eqNullSafe(F.col("h")))
    assert both.count() == 13 and both.where(F.abs(F.col("a") - F.col("b")) > 6 * relative_error() * F.col("b")).count() == 0


def test_union_of_small_groups_may_pass_the_threshold(spark):
    log = spark.range(300).select((F.col("id") % 2).alias("h"), F.concat(F.lit("x"), "id").alias("v"), F.lit(1).alias("g"))
    merged = merged_states(distinct_states(log, ["g", "h"], "v", 150), ["g"], 150).select(is_exact().alias("e"), distinct_count().alias("n")).first()
    assert not merged["e"] and abs(merged["n"] - 300) <= 3 * relative_error() * 300


def test_nothing_from_nothing(spark, log):
    none = distinct_states(log.where("false"), ["g"], "v", 5)
    assert none.count() == 0 and merged_states(none, ["g"], 5).count() == 0


def test_large_groups_are_never_collected(log):
    plan = distinct_states(log, ["g"], "v", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_set") == 1 and "LeftSemi" in plan
