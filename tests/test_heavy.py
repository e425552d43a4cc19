"""The heaviest keys from a sketch, proven by exact counts, else from a full count."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators.heavy import candidates, is_proven, top_keys
from tests.conftest import rows


def plain(df, k):
    return df.where("a IS NOT NULL").groupBy("a").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a").limit(k)


@pytest.fixture(scope="module")
def skewed(spark):
    """Key k of twelve has about 2 ** -k of 40,000 rows, the rest are all different; some are NULL."""
    rank = F.when(F.col("id") % 7 == 0, None).otherwise(F.length(F.regexp_extract(F.bin("id"), "0*$", 0)))
    return spark.range(40_000).select(F.when(rank.isNull(), None).when(rank > 8, F.concat(F.lit("rare"), "id")).otherwise(F.concat(F.lit("k"), rank)).alias("a"))


def test_proven_top_keys_equal_the_full_count(skewed):
    top, total, proven = top_keys(skewed, "a", 4, tracked=1000)
    assert proven and total == 40_000 and rows(top, "a", "n") == rows(plain(skewed, 4), "a", "n")


def test_even_counts_fall_back_to_the_full_count(spark):
    even = spark.range(30_000).select(F.concat(F.lit("u"), F.col("id") % 5000).alias("a"))
    top, total, proven = top_keys(even, "a", 5, tracked=100)
    assert not proven and rows(top, "a", "n") == rows(plain(even, 5), "a", "n") == [(f"u{x}", 6) for x in (0, 1, 10, 100, 1000)]


def test_the_sketch_is_bounded_and_misses_no_heavy_key(skewed):
    found = {r["a"] for r in candidates(skewed, "a", 300).collect()}
    assert len(found) <= 300
    bound = 7 * 40_000 / 300
    assert {r["a"] for r in plain(skewed, 50).collect() if r["n"] > bound} <= found


def test_proof():
    assert is_proven(701, 3, 3, 1000, 10) and not is_proven(700, 3, 3, 1000, 10)
    assert not is_proven(900, 2, 3, 1000, 10) and not is_proven(None, 0, 1, 0, 10)


def test_empty_and_null_only(spark):
    for df in (spark.range(0), spark.range(5)):
        top, total, proven = top_keys(df.select(F.lit(None).cast("string").alias("a")), "a", 3)
        assert top.count() == 0 and not proven and total == df.count()
