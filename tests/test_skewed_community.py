"""A community in which one author writes a third of all posts."""

from pyspark.sql import functions as F

from cohortlens.operators.enrich import attach_users
from cohortlens.operators.facts import in_community
from cohortlens.plans.community import Community
from cohortlens.sources import fixture
from tests.conftest import SMALL, rows


def _skewed(spark, **kw):
    comments, submissions = fixture.community(spark, SMALL)
    heavy = F.when(F.xxhash64("created_utc", "subreddit") % 3 == 0, F.lit("heavy")).otherwise(F.col("author"))
    comments = comments.withColumn("author", F.when(F.col("author").isNull(), None).otherwise(heavy))
    return Community(comments, submissions, fixture.FIXTURE, **kw)


def test_heavy_author_results_equal_direct(spark):
    c = _skewed(spark, rows_per_task=100, max_hot=50)
    plain = _skewed(spark, skew_safe=False)
    heavy_share = c.posts.agg(F.avg((F.col("author") == "heavy").cast("double"))).first()[0]
    assert heavy_share > 0.25
    for measure in ("posts_per_user", "comment_length", "comments_per_submission"):
        a = rows(c.metric(measure, "user", "cohort", overlap=True))
        b = rows(plain.metric(measure, "user", "cohort", overlap=True, method="direct"))
        assert a == b, measure


def test_heavy_author_is_spread_over_tasks(spark):
    c = _skewed(spark, rows_per_task=100, max_hot=50)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = attach_users(in_community(c.posts), c.users, c.skew)
        per_task = (
            joined.where(F.col("author") == "heavy").groupBy(F.spark_partition_id().alias("p")).count().collect()
        )
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    total = sum(r["count"] for r in per_task)
    assert len(per_task) >= 4
    assert max(r["count"] for r in per_task) < total / 2
