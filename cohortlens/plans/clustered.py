"""Base tables in the catalog, laid out by author, so that posts meet their authors without another shuffle.

Posts are bucketed and sorted by author, as are the users: joining them and summing by author reads bucket against bucket, with
no exchange on either side, each time the tables are used. An author with more than ``rows_per_task`` posts would make one bucket too
large; those authors' posts are a table of their own, in no order, and meet the few hot users by broadcast
(fewer than all posts / ``rows_per_task`` of them, checked; more than ``max_hot`` are joined by a salted shuffle). Their cells
are summed in each task before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.clocks import user_month
from cohortlens.operators.enrich import attach_users
from cohortlens.operators.facts import CELL_MEASURES, cell_aggregates, in_community
from cohortlens.plans.community import Community
from cohortlens.spec import CohortSpec


@dataclass(frozen=True)
class Clustered:
    """Names of the three tables: ``<name>_posts``, ``<name>_hot_posts``, ``<name>_users``."""

    spark: SparkSession
    name: str
    spec: CohortSpec
    rows_per_task: int = 4_000_000
    max_hot: int = 10_000

    def table(self, part: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}")

    @property
    def posts(self) -> DataFrame:
        return self.table("posts").unionByName(self.table("hot_posts"))

    def _cells(self, per_post: DataFrame) -> DataFrame:
        month = user_month("created_utc", "u_min_created_utc", self.spec)
        return per_post.groupBy("author", month.alias("user_month"), "u_year", "u_survival").agg(*cell_aggregates()).select(
            "author", "u_year", "u_survival", "user_month", *CELL_MEASURES)

    def cold_cells(self) -> DataFrame:
        """User cells of all authors but the hot ones: bucket against bucket."""
        return self._cells(attach_users(in_community(self.table("posts")), self.table("users"), None))

    def hot_cells(self) -> DataFrame:
        hot = self.table("users").where(F.col("n_posts") > self.rows_per_task)
        posts = in_community(self.table("hot_posts"))
        if hot.count() <= self.max_hot:
            return self._cells(attach_users(posts, F.broadcast(hot), None))
        return self._cells(attach_users(posts, hot, {"rows_per_task": self.rows_per_task, "max_hot": self.max_hot}))

    def user_cells(self) -> DataFrame:
        return self.cold_cells().unionByName(self.hot_cells())

    def community(self, **kw) -> Community:
        """A community over these tables; its user cells need no shuffle of cold posts."""
        c = Community.from_posts(self.posts, self.spec, **kw)
        c.__dict__["users"] = self.table("users")
        c.__dict__["user_cells"] = c._keep(self.user_cells(), "user-cells")
        return c


ROWS_PER_BUCKET = 1_000_000


def buckets_for(c: Community, least: int = 1) -> int:
    """Buckets of about a million posts, some 100 MB when sorted, but no fewer than ``least``."""
    posts = c.users.agg(F.sum("n_posts")).first()[0] or 0
    return max(least, -(-posts // ROWS_PER_BUCKET))


def save_clustered(c: Community, name: str, root: str, buckets: int = 200, mode: str = "errorifexists") -> Clustered:
    """Saves posts and users of ``c`` as catalog tables, their files under ``root``. ``buckets``: see ``buckets_for``; the
    posts are shuffled by author here, once."""
    skew = c.skew or {"rows_per_task": 4_000_000, "max_hot": 10_000}
    out = Clustered(c.posts.sparkSession, name, c.spec, **skew)
    hot = c.users.where(F.col("n_posts") > out.rows_per_task).select("author")
    few = hot.count() <= out.max_hot
    hot = F.broadcast(hot) if few else hot

    def save(df: DataFrame, part: str, clustered: bool) -> None:
        writer = df.repartition(buckets, "author").write.bucketBy(buckets, "author").sortBy("author") if clustered else df.write
        writer.mode(mode).option("path", f"{root.rstrip('/')}/{part}").saveAsTable(f"{name}_{part}")

    save(c.posts.join(hot, "author", "left_anti"), "posts", True)
    save(c.posts.join(hot, "author", "left_semi"), "hot_posts", False)
    save(c.users, "users", True)
    return out
