"""First-seen dimensions: one row per author and one row per community.

Both are hash aggregates with map-side partial aggregation, so a prolific author (or a
huge community) costs one partial row per map task before the shuffle, not one per post.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.clocks import cohort_year, survival_years
from cohortlens.spec import CohortSpec

USER_COLUMNS = ("author", "min_created_utc", "year", "time_active")


def _users(agg: DataFrame, spec: CohortSpec) -> DataFrame:
    time_active = F.col("max_created_utc") - F.col("min_created_utc")
    return agg.select(
        "author",
        "min_created_utc",
        cohort_year("min_created_utc", spec).alias("year"),
        time_active.alias("time_active"),
        survival_years(time_active, spec).alias("survival"),
        "n_posts",
    )


def users_dim(posts: DataFrame, spec: CohortSpec) -> DataFrame:
    """author, min_created_utc, year (cohort), time_active, plus survival and n_posts.

    ``n_posts`` is the author's row count in ``posts``; the skew-aware join uses it to
    find and split prolific authors. Select ``USER_COLUMNS`` for the plain table.
    """
    agg = posts.groupBy("author").agg(
        F.min("created_utc").alias("min_created_utc"),
        F.max("created_utc").alias("max_created_utc"),
        F.count(F.lit(1)).alias("n_posts"),
    )
    return _users(agg, spec)


def users_from_cells(author_cells: DataFrame, spec: CohortSpec) -> DataFrame:
    """The same table as ``users_dim``, from (author, month) cells with first/last post
    times: one row per author-month instead of one per post."""
    agg = author_cells.groupBy("author").agg(
        F.min("min_created_utc").alias("min_created_utc"),
        F.max("max_created_utc").alias("max_created_utc"),
        F.sum("n_posts").cast("long").alias("n_posts"),
    )
    return _users(agg, spec)


SUBREDDIT_COLUMNS = ("subreddit", "min_created_utc")


def subreddits_dim(posts: DataFrame) -> DataFrame:
    """subreddit, min_created_utc, n_posts. Posts without a community form one NULL row
    (as in GROUP BY); the equi-join with posts never matches it."""
    return posts.groupBy("subreddit").agg(
        F.min("created_utc").alias("min_created_utc"),
        F.count(F.lit(1)).alias("n_posts"),
    )


def subreddits_from_cells(community_cells: DataFrame) -> DataFrame:
    """The same table as ``subreddits_dim``, from (community, month) cells."""
    return community_cells.groupBy("subreddit").agg(
        F.min("min_created_utc").alias("min_created_utc"),
        F.sum("n_posts").cast("long").alias("n_posts"),
    )
