"""The salted join splits heavy keys and returns exactly the plain inner join."""

from pyspark.sql import functions as F

from cohortlens.operators.enrich import enrich_posts
from cohortlens.operators.skew import N_SALTS, ROW, SALT, hot_keys, numbered, salted_join
from tests.conftest import rows


def _frames(spark):
    # key "hot" holds a third of all rows, as a prolific author might
    big = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        F.col("id").alias("v"),
    )
    dim = big.groupBy("k").agg(F.count(F.lit(1)).alias("w"), F.min("v").alias("first"))
    return big, dim


def test_every_heavy_key_is_hot_whatever_the_total(spark):
    _, dim = _frames(spark)
    hot = hot_keys(dim, "k", "w", rows_per_task=100).collect()
    assert [(r.k, r[N_SALTS]) for r in hot] == [("hot", 10)]
    assert hot_keys(dim, "k", "w", rows_per_task=30).count() == 51


def test_salted_join_equals_plain_join(spark):
    big, dim = _frames(spark)
    salted = salted_join(big, dim, "k", "w", rows_per_task=100, max_hot=10)
    plain = big.join(dim, "k")
    assert salted.count() == 3000
    assert rows(salted, "k", "v", "w", "first") == rows(plain, "k", "v", "w", "first")


def test_salted_join_spreads_the_hot_key(spark):
    big, dim = _frames(spark)
    # at this toy size Spark would broadcast a whole side; force the shuffle join that
    # a large fact table gets
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        salted = salted_join(big, dim, "k", "w", rows_per_task=100, max_hot=10)
        per_task = salted.where(F.col("k") == "hot").groupBy(F.spark_partition_id().alias("p")).count().collect()
        plan = salted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(per_task) > 1
    assert max(r["count"] for r in per_task) < 1000
    assert "SortMergeJoin" in plan
    assert "BroadcastHashJoin" in plan  # only the bounded hot-key list is broadcast


def _no_broadcast(spark, build):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = build()
        return df.where(F.col("k") == "hot").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_more_hot_keys_than_are_broadcast(spark):
    big, dim = _frames(spark)
    salted = salted_join(big, dim, "k", "w", rows_per_task=10, max_hot=3)
    assert rows(salted, "k", "v", "w", "first") == rows(big.join(dim, "k"), "k", "v", "w", "first")
    per_task = _no_broadcast(spark, lambda: salted_join(big, dim, "k", "w", rows_per_task=10, max_hot=3))
    assert max(r["count"] for r in per_task) < 500


def test_equal_rows_of_a_hot_key_are_spread(spark):
    big = spark.range(2000).select(F.lit("hot").alias("k"), F.lit(7).alias("v"))
    dim = big.groupBy("k").agg(F.count(F.lit(1)).alias("w"))
    per_task = _no_broadcast(spark, lambda: salted_join(big, dim, "k", "w", rows_per_task=100))
    assert sum(r["count"] for r in per_task) == 2000 and len(per_task) >= 4


def test_no_hot_key(spark):
    big, dim = _frames(spark)
    joined = salted_join(big, dim, "k", "w", rows_per_task=10_000, max_hot=10)
    assert rows(joined, "k", "v", "w", "first") == rows(big.join(dim, "k"), "k", "v", "w", "first")


def test_salts_do_not_depend_on_the_order_behind_a_shuffle(spark):
    """Rows that reach the second join in any order, as after a lost executor, get the salts of their first scan."""
    big, dim = _frames(spark)
    scan = spark.createDataFrame(numbered(big).collect(), "k string, v long, _row long")
    salts = []
    for n in (3, 7):
        shuffled = scan.repartition(n, F.rand(n))
        joined = salted_join(shuffled, dim, "k", "w", rows_per_task=100, row=ROW)
        assert joined.count() == 3000 and "monotonically_increasing_id" not in joined._jdf.queryExecution().optimizedPlan().toString()
        salts.append(rows(joined.select("v", F.pmod(F.col(ROW), F.ceil(F.col("w") / 100)).alias(SALT)), "v", SALT))
    assert salts[0] == salts[1]


def test_enriched_posts_are_numbered_once_in_their_scan(spark, small_community):
    c = small_community
    for skew in ({}, {"rows_per_task": 50, "max_hot": 10}):
        df = enrich_posts(c.posts, c.users, c.subreddits, c.spec, skew)
        assert df._jdf.queryExecution().optimizedPlan().toString().count("monotonically_increasing_id") == 1
        assert ROW not in df.columns and rows(df) == rows(enrich_posts(c.posts, c.users, c.subreddits, c.spec, None))
