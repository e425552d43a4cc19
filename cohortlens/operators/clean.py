"""Cleaning of the two raw streams into one post table.

Each cleaned row keeps only what the analyses read: ``body_size`` (the text itself is
dropped right here, so it never reaches a shuffle), author, creation time, community
and two kind flags. The not-null and not-deleted predicates are simple comparisons
that Spark pushes into the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.names import keep_author
from cohortlens.spec import CohortSpec

POST_COLUMNS = ("body_size", "author", "created_utc", "subreddit", "comment", "submission")


def _as_posts(raw: DataFrame, size: Column, comment: int) -> DataFrame:
    """A raw stream in the post layout; ``comment`` is 1 for comments, 0 for submissions."""
    return raw.select(
        size.cast("long").alias("body_size"),
        "author",
        F.col("created_utc").cast("long").alias("created_utc"),
        "subreddit",
        F.lit(comment).alias("comment"),
        F.lit(1 - comment).alias("submission"),
    )


def comments_as_posts(raw: DataFrame) -> DataFrame:
    """Comments: size = characters of the body (NULL body -> NULL size, row kept)."""
    return _as_posts(raw, F.length("body"), 1)


def submissions_as_posts(raw: DataFrame) -> DataFrame:
    """Submissions: size = characters of title + selftext (NULL if either is NULL)."""
    return _as_posts(raw, F.length("title") + F.length("selftext"), 0)


def _keep(posts: DataFrame) -> DataFrame:
    """The cleaning rules; the optimizer moves them below the projection into the scan."""
    return posts.where(F.col("created_utc").isNotNull() & keep_author("author"))


def clean_comments(raw: DataFrame) -> DataFrame:
    return _keep(comments_as_posts(raw))


def clean_submissions(raw: DataFrame) -> DataFrame:
    return _keep(submissions_as_posts(raw))


def clean_posts(raw_comments: DataFrame, raw_submissions: DataFrame) -> DataFrame:
    """Posts = cleaned comments UNION ALL cleaned submissions (a narrow union)."""
    return clean_comments(raw_comments).unionByName(clean_submissions(raw_submissions))


def union_raw(raw_comments: DataFrame, raw_submissions: DataFrame) -> DataFrame:
    """Both raw streams in the post layout, before any cleaning rule."""
    return comments_as_posts(raw_comments).unionByName(submissions_as_posts(raw_submissions))


def window_filter(posts: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Keep posts created in [start, end) (epoch seconds); a range predicate that
    reaches the scan (row-group skipping on sorted logs, partition pruning on shards)."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("created_utc") >= F.lit(start))
    if end is not None:
        cond = cond & (F.col("created_utc") < F.lit(end))
    return posts.where(cond)


def apply_window(posts: DataFrame, spec: CohortSpec) -> DataFrame:
    if spec.window is None:
        return posts
    return window_filter(posts, *spec.window)
