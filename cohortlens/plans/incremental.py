"""Adding new shards to a community whose base tables are saved, without building them anew.

The new posts are scanned alone. Their month cells are added to the saved ones (cells are sums and extremes), and users,
communities and calendar cells follow from the cells. User cells of the old posts stay as they are, unless
an author's first post moves to an earlier time: only then are that author's old posts read again,
as every one of them now lies in another month since the first. Cohort and survival are attached anew to all
cells, as they can change with any post.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.facts import CELL_MEASURES, EXTREMES, user_cells
from cohortlens.operators.skew import ROW, numbered
from cohortlens.plans.community import Community

CELL_KEYS = ("kind", "author", "subreddit", "cal_month", "in_community")


def added_month_cells(old: DataFrame, new: DataFrame) -> DataFrame:
    """Month cells of both sets of posts together."""
    low, high = EXTREMES
    sums = [F.sum(c).cast("long").alias(c) for c in CELL_MEASURES]
    return old.unionByName(new).groupBy(*CELL_KEYS).agg(*sums, F.min(low).alias(low), F.max(high).alias(high))


def moved_authors(old_users: DataFrame, users: DataFrame) -> DataFrame:
    """Authors whose first post is earlier than it was."""
    was = old_users.select("author", F.col("min_created_utc").alias("_was"))
    return users.join(was, "author").where(F.col("min_created_utc") < F.col("_was")).select("author")


def added_user_cells(c: Community, new_posts: DataFrame, users: DataFrame, moved: DataFrame) -> DataFrame:
    """User cells of the old and the new posts; the old posts are read for ``moved`` authors only."""
    parts = c.user_cells.join(moved, "author", "left_anti").unionByName(user_cells(new_posts, users, c.spec, c.skew))
    if not moved.isEmpty():
        again = numbered(c.posts).join(moved, "author", "left_semi")  # numbered in the scan: salts outlive a lost executor
        parts = parts.unionByName(user_cells(again, users, c.spec, None if c.skew is None else {**c.skew, "row": ROW}))
    sums = parts.groupBy("author", "user_month").agg(*[F.sum(m).cast("long").alias(m) for m in CELL_MEASURES])
    attributes = users.select("author", F.col("year").alias("u_year"), F.col("survival").alias("u_survival"))
    return sums.join(attributes, "author").select("author", "u_year", "u_survival", "user_month", *CELL_MEASURES)


def extended(c: Community, raw_comments: DataFrame, raw_submissions: DataFrame) -> Community:
    """A community with the posts of ``c`` and of the new raw logs, its base tables kept as those of ``c`` are.

    Equal to building everything from both logs together. Rows that both have are counted twice, as in a union. ``c``
    is unchanged and stays usable.
    """
    def both(a: DataFrame | None, b: DataFrame) -> DataFrame | None:
        return None if a is None else a.unionByName(b)

    options = {"skew_safe": c.skew_safe, "materialize": c.materialize, "persist": c.persist} | (c.skew or {})
    new = Community(raw_comments, raw_submissions, c.spec, **options)
    out = Community(both(c.raw_comments, raw_comments), both(c.raw_submissions, raw_submissions), c.spec, **options)
    out.__dict__["posts"] = c.posts.unionByName(new.posts)
    out.__dict__["month_cells"] = out._keep(added_month_cells(c.month_cells, new.month_cells), "month-cells", partition_by=["kind"])
    moved = out._keep(moved_authors(c.users, out.users), "moved-authors")
    out.__dict__["user_cells"] = out._keep(added_user_cells(c, new.posts, out.users, moved), "user-cells")
    return out
