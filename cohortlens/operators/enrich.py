"""Posts joined with their author's first-seen attributes (and their community's).

Both joins are N:1 with a dimension aggregated from the same posts, so the author
join never loses a row (every cleaned author is in ``users``) and the community join
only loses rows whose community is NULL. Both go through the skew-aware join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.clocks import cal_month, calendar_x, user_month, user_x
from cohortlens.operators.skew import ROW, numbered, salted_join
from cohortlens.spec import CohortSpec

META_COLUMNS = (
    "body_size",
    "author",
    "created_utc",
    "cal_month",
    "time",
    "subreddit",
    "comment",
    "submission",
    "u_min_created_utc",
    "u_year",
    "u_time_active",
    "user_month",
    "u_time",
    "s_min_created_utc",
)


def _user_attrs(users: DataFrame) -> DataFrame:
    return users.select(
        "author",
        F.col("min_created_utc").alias("u_min_created_utc"),
        F.col("year").alias("u_year"),
        F.col("time_active").alias("u_time_active"),
        F.col("survival").alias("u_survival"),
        "n_posts",
    )


def attach_users(posts: DataFrame, users: DataFrame, skew: dict | None = None) -> DataFrame:
    """Add u_min_created_utc, u_year, u_time_active, u_survival to every post.

    ``skew``: keyword arguments of the salted join (``{}`` for its defaults); None joins
    plainly."""
    u = _user_attrs(users)
    if skew is None:
        joined = posts.join(u, "author")
    else:
        joined = salted_join(posts, u, "author", "n_posts", **skew)
    return joined.drop("n_posts")


def enrich_posts(
    posts: DataFrame,
    users: DataFrame,
    subreddits: DataFrame,
    spec: CohortSpec,
    skew: dict | None = None,
) -> DataFrame:
    """The wide post table: posts ⋈ users ⋈ subreddits plus both clocks. With ``skew`` the posts are
    numbered once, in their scan, and both joins salt by that number."""
    if skew is not None:
        posts, skew = numbered(posts), {**skew, "row": ROW}
    with_user = attach_users(posts, users, skew)
    s = subreddits.select(
        "subreddit", F.col("min_created_utc").alias("s_min_created_utc"), F.col("n_posts").alias("s_posts")
    )
    if skew is None:
        joined = with_user.join(s, "subreddit")
    else:
        joined = salted_join(with_user, s, "subreddit", "s_posts", **skew)
    cm = cal_month("created_utc", spec)
    um = user_month("created_utc", "u_min_created_utc", spec)
    return joined.select(
        "body_size",
        "author",
        "created_utc",
        cm.alias("cal_month"),
        calendar_x(cm, spec).alias("time"),
        "subreddit",
        "comment",
        "submission",
        "u_min_created_utc",
        "u_year",
        "u_time_active",
        um.alias("user_month"),
        user_x(um).alias("u_time"),
        "s_min_created_utc",
    )
