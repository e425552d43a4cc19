"""Pre-aggregated (author, month) cells: the compact input of every per-user measure.

A group of the analyses (a month, a cohort-month, a survival-month, ...) always consists
of whole (author, month) cells of one clock, so

* active authors of a group      = number of cells in it (no COUNT DISTINCT, no Expand),
* posts / comments / submissions = sums of the cell counts,
* total comment length           = sum of the cell sums.

All sums are exact integers and the single division happens at the very end, so the
result is identical to aggregating the raw posts directly. Cells are built with a
partial (map-side) aggregate, so what crosses the network is at most one partial row per
(author, month) and map task, instead of every post.

One GROUPING SETS pass over the posts (``month_cells``) yields both the (author, month)
cells — with each cell's first and last post time — and the (community, month) cells.
Everything on the calendar clock derives from that small table: the users dimension
(first post = min of the cells' first posts; the cohort year of a post depends only on
its calendar month, because a year is exactly twelve months), the communities dimension,
and the calendar cells with cohort and survival attached at cell grain (a prolific author
has one row per month, so that join is not skewed). Only user-clock cells need each
post's distance to the author's first post, i.e. a second, per-post (skew-aware) pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.clocks import cal_month, user_month
from cohortlens.operators.enrich import attach_users
from cohortlens.spec import CohortSpec

CELL_MEASURES = ("n_posts", "n_comments", "n_submissions", "sum_comment_size")


def cell_aggregates() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_posts"),
        F.sum("comment").cast("long").alias("n_comments"),
        F.sum("submission").cast("long").alias("n_submissions"),
        F.sum(F.when(F.col("comment") == 1, F.col("body_size"))).cast("long").alias("sum_comment_size"),
    ]


EXTREMES = ("min_created_utc", "max_created_utc")


def month_cells(posts: DataFrame, spec: CohortSpec) -> DataFrame:
    """Every calendar-month fact in one scan of ``posts``.

    kind = 'author':    author, cal_month, in_community + cell measures, first/last post
    kind = 'community': subreddit, cal_month + n_posts, first post (NULL community kept,
                        as in GROUP BY subreddit)
    GROUPING SETS expands each post into its two grouping rows inside the task and
    aggregates them partially before the one shuffle.
    """
    p = posts.select(
        "author",
        "subreddit",
        "comment",
        "submission",
        "body_size",
        "created_utc",
        cal_month("created_utc", spec).alias("cal_month"),
        F.col("subreddit").isNotNull().alias("in_community"),
    )
    g = p.groupingSets(
        [["author", "cal_month", "in_community"], ["subreddit", "cal_month"]],
        "author",
        "subreddit",
        "cal_month",
        "in_community",
    ).agg(
        *cell_aggregates(),
        F.min("created_utc").alias("min_created_utc"),
        F.max("created_utc").alias("max_created_utc"),
        F.grouping("author").alias("_by_community"),
    )
    return g.select(
        F.when(F.col("_by_community") == 0, F.lit("author")).otherwise(F.lit("community")).alias("kind"),
        "author",
        "subreddit",
        "cal_month",
        "in_community",
        *CELL_MEASURES,
        *EXTREMES,
    )


def author_month_cells(cells: DataFrame) -> DataFrame:
    """(author, cal_month, in_community) cells of ``month_cells``."""
    return cells.where(F.col("kind") == "author").select(
        "author", "cal_month", "in_community", *CELL_MEASURES, *EXTREMES
    )


def community_month_cells(cells: DataFrame) -> DataFrame:
    """(subreddit, cal_month) cells of ``month_cells``, including the NULL community."""
    return cells.where(F.col("kind") == "community").select("subreddit", "cal_month", "n_posts", "min_created_utc")


def in_community(posts: DataFrame) -> DataFrame:
    """Posts that reach the enriched table: the community join drops NULL communities."""
    return posts.where(F.col("subreddit").isNotNull())


def calendar_cells(author_cells: DataFrame, users: DataFrame) -> DataFrame:
    """author, cal_month + cell measures + u_year, u_survival; cells inside communities."""
    cells = author_cells.where(F.col("in_community")).select("author", "cal_month", *CELL_MEASURES)
    u = users.select("author", F.col("year").alias("u_year"), F.col("survival").alias("u_survival"))
    return cells.join(u, "author")


def user_cells(posts: DataFrame, users: DataFrame, spec: CohortSpec, skew: dict | None = None) -> DataFrame:
    """author, u_year, u_survival, user_month + cell measures (``skew``: salted-join
    arguments, None for a plain join)."""
    per_post = attach_users(in_community(posts), users, skew)
    return per_post.groupBy(
        "author",
        "u_year",
        "u_survival",
        user_month("created_utc", "u_min_created_utc", spec).alias("user_month"),
    ).agg(*cell_aggregates())
