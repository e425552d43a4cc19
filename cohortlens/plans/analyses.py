"""The thirteen series analyses of the study, each one job over a Community.

Q1-Q2 describe growth and activity, Q3-Q7 posts per active user, Q8-Q10 mean comment
length, Q11-Q13 comments per submission; each measure is looked at on the calendar
clock, on the user clock by cohort (with the overlap window), and split by survival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.clocks import cal_month, calendar_x
from cohortlens.operators.facts import in_community
from cohortlens.operators.series import as_series, cumulative, ordered
from cohortlens.plans.community import Community

# Series labels of the analyses.
CUMULATIVE_USERS = "Cumulative number of users"
CUMULATIVE_SUBREDDITS = "Cumulative number of subreddits"
ACTIVE_USERS = "Number of active users"
ACTIVE_SUBREDDITS = "Number of active subreddits"
POSTS_PER_SURVIVING_USER = "Number of posts per surviving user"

# Axis labels (x, y) of each analysis, with underscores as in the result
# column names of the study; ``pretty`` turns them into display text.
TIME, USER_TIME = "Time_", "Time_in_user_referential"
PPU, LEN, CPS = "Average_number_of_posts_per_user", "Average_comment_length", "Comments_per_submission"
AXIS_LABELS = {
    "q01_cumulative_growth": (TIME, "Cumulative_number"),
    "q02_active_monthly": (TIME, "Active_number"),
    "q03_posts_per_user_time": (TIME, PPU),
    "q04_posts_per_user_utime": (USER_TIME, PPU),
    "q05_posts_per_user_cohort_time": (TIME, PPU),
    "q06_posts_per_user_cohort_utime": (USER_TIME, PPU),
    "q07_posts_per_user_survival": (USER_TIME, PPU),
    "q08_comment_len_cohort_time": (TIME, LEN),
    "q09_comment_len_cohort_utime": (USER_TIME, LEN),
    "q10_comment_len_survival": (USER_TIME, LEN),
    "q11_ratio_cohort_time": (TIME, CPS),
    "q12_ratio_cohort_utime": (USER_TIME, CPS),
    "q13_ratio_survival": (USER_TIME, CPS),
}


def pretty(label: str) -> str:
    """Display text of a label: underscores become spaces."""
    return label.replace("_", " ").strip()


def with_axis_labels(df: DataFrame, name: str, display: bool = False) -> DataFrame:
    """The series of analysis ``name`` with x / y renamed to its axis labels."""
    x, y = AXIS_LABELS[name]
    if display:
        x, y = pretty(x), pretty(y)
    return df.withColumnsRenamed({"x": x, "y": y})


def first_month_counts(c: Community) -> DataFrame:
    """kind ('user'/'subreddit'), m (calendar month of first post), n (how many),
    from the two first-seen dimensions."""
    fs = c.users.select(F.lit("user").alias("kind"), "min_created_utc").unionByName(
        c.subreddits.select(F.lit("subreddit").alias("kind"), "min_created_utc")
    )
    return fs.groupBy("kind", cal_month("min_created_utc", c.spec).alias("m")).agg(
        F.count(F.lit(1)).alias("n")
    )


def q01_cumulative_growth(c: Community, share: bool = False) -> DataFrame:
    """Cumulative number of users and communities by month of their first post."""
    g = first_month_counts(c)
    series = F.when(F.col("kind") == "user", F.lit(CUMULATIVE_USERS)).otherwise(F.lit(CUMULATIVE_SUBREDDITS))
    return ordered(cumulative(as_series(g, calendar_x("m", c.spec), series, F.col("n")), share=share))


def active_counts(c: Community, approx_rsd: float | None = None) -> DataFrame:
    """kind ('users' / 'subreddits'), m, n: distinct active authors and communities per
    calendar month.

    Exact counts come from the (author, month) and (community, month) cells: a month's
    active authors are its cells, so no distinct count over posts is needed, and the two
    per-month counts are simply stacked. ``approx_rsd`` instead sketches both counts
    (HyperLogLog++) in one scan of the posts.
    """
    if approx_rsd is None:
        users = c.calendar_cells_plain.groupBy(F.col("cal_month").alias("m")).agg(F.count(F.lit(1)).alias("n"))
        subs = c.community_cells.groupBy(F.col("cal_month").alias("m")).agg(F.count(F.lit(1)).alias("n"))
        return users.select(F.lit("users").alias("kind"), "m", "n").unionByName(
            subs.select(F.lit("subreddits").alias("kind"), "m", "n")
        )
    p = in_community(c.posts).select("author", "subreddit", cal_month("created_utc", c.spec).alias("m"))
    wide = p.groupBy("m").agg(
        F.approx_count_distinct("author", approx_rsd).alias("users"),
        F.approx_count_distinct("subreddit", approx_rsd).alias("subreddits"),
    )
    return wide.unpivot("m", ["users", "subreddits"], "kind", "n").select("kind", "m", "n")


def q02_active_monthly(c: Community, approx_rsd: float | None = None) -> DataFrame:
    """Active users and active communities per calendar month (>= 1 post in the month)."""
    g = active_counts(c, approx_rsd)
    series = F.when(F.col("kind") == "users", F.lit(ACTIVE_USERS)).otherwise(F.lit(ACTIVE_SUBREDDITS))
    return ordered(as_series(g, calendar_x("m", c.spec), series, F.col("n")))


def q03_posts_per_user_time(c: Community, **kw) -> DataFrame:
    return c.metric("posts_per_user", "calendar", label=POSTS_PER_SURVIVING_USER, **kw)


def q04_posts_per_user_utime(c: Community, **kw) -> DataFrame:
    return c.metric("posts_per_user", "user", max_user_month=c.spec.max_user_month, **kw)


def q05_posts_per_user_cohort_time(c: Community, **kw) -> DataFrame:
    return c.metric("posts_per_user", "calendar", "cohort", overall=True, overall_scope="all", **kw)


def q06_posts_per_user_cohort_utime(c: Community, **kw) -> DataFrame:
    return c.metric("posts_per_user", "user", "cohort", overlap=True, **kw)


def q07_posts_per_user_survival(c: Community, **kw) -> DataFrame:
    return c.metric("posts_per_user", "user", "survival", cohorts=c.spec.survival_cohorts, **kw)


def q08_comment_len_cohort_time(c: Community, **kw) -> DataFrame:
    return c.metric("comment_length", "calendar", "cohort", overall=True, overall_scope="all", **kw)


def q09_comment_len_cohort_utime(c: Community, **kw) -> DataFrame:
    return c.metric("comment_length", "user", "cohort", overlap=True, **kw)


def q10_comment_len_survival(c: Community, **kw) -> DataFrame:
    return c.metric("comment_length", "user", "survival", cohorts=c.spec.survival_cohorts, **kw)


def q11_ratio_cohort_time(c: Community, **kw) -> DataFrame:
    return c.metric("comments_per_submission", "calendar", "cohort", overall=True, overall_scope="selected", **kw)


def q12_ratio_cohort_utime(c: Community, **kw) -> DataFrame:
    return c.metric("comments_per_submission", "user", "cohort", overlap=True, **kw)


def q13_ratio_survival(c: Community, **kw) -> DataFrame:
    return c.metric("comments_per_submission", "user", "survival", cohorts=c.spec.ratio_survival_cohorts, **kw)


ANALYSES = {
    "q01_cumulative_growth": q01_cumulative_growth,
    "q02_active_monthly": q02_active_monthly,
    "q03_posts_per_user_time": q03_posts_per_user_time,
    "q04_posts_per_user_utime": q04_posts_per_user_utime,
    "q05_posts_per_user_cohort_time": q05_posts_per_user_cohort_time,
    "q06_posts_per_user_cohort_utime": q06_posts_per_user_cohort_utime,
    "q07_posts_per_user_survival": q07_posts_per_user_survival,
    "q08_comment_len_cohort_time": q08_comment_len_cohort_time,
    "q09_comment_len_cohort_utime": q09_comment_len_cohort_utime,
    "q10_comment_len_survival": q10_comment_len_survival,
    "q11_ratio_cohort_time": q11_ratio_cohort_time,
    "q12_ratio_cohort_utime": q12_ratio_cohort_utime,
    "q13_ratio_survival": q13_ratio_survival,
}
