"""Catalog tables by author: no exchange of cold posts, hot authors apart."""

import uuid

import pytest
from pyspark.sql import functions as F

from cohortlens.plans.clustered import save_clustered
from cohortlens.plans.community import Community
from tests.conftest import rows


@pytest.fixture(scope="module")
def tables(small_community, tmp_path_factory):
    c = Community.from_posts(small_community.posts, small_community.spec, rows_per_task=60)
    c.__dict__["users"] = small_community.users
    return save_clustered(c, f"t{uuid.uuid4().hex}", str(tmp_path_factory.mktemp("clustered")), buckets=4)


def test_cells_and_posts_equal_the_plain_ones(small_community, tables):
    want = small_community.user_cells
    assert rows(tables.user_cells(), *want.columns) == rows(want)
    assert rows(tables.posts, *small_community.posts.columns) == rows(small_community.posts)


def test_hot_authors_are_apart(small_community, tables):
    heavy = {r["author"] for r in small_community.users.where("n_posts > 60").collect()}
    assert heavy and {r["author"] for r in tables.table("hot_posts").select("author").distinct().collect()} == heavy
    assert tables.table("posts").where(F.col("author").isin(list(heavy))).count() == 0


def test_cold_posts_are_not_exchanged(spark, tables):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tables.cold_cells()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == 2


def test_many_hot_authors_are_joined_by_salted_shuffle(small_community, tables):
    from dataclasses import replace

    many = replace(tables, max_hot=1)
    assert rows(many.hot_cells()) == rows(tables.hot_cells())


def test_a_community_over_the_tables(small_community, tables):
    c = tables.community()
    for measure, clock, by in (("posts_per_user", "user", "cohort"), ("comment_length", "calendar", "cohort")):
        assert rows(c.metric(measure, clock, by)) == rows(small_community.metric(measure, clock, by))
