"""Analyses stated in the paper on top of the same primitives.

All run on the (author, month) cells or on the dimensions; windows only ever see
aggregated rows (one per series and month, or per year and cohort), which are bounded
by the observation window and the number of cohorts, never by the number of posts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.clocks import cal_year, calendar_x, ratio, user_x
from cohortlens.functions.names import drop_reason
from cohortlens.operators.clean import union_raw
from cohortlens.operators.heavy import top_keys
from cohortlens.operators.series import as_series, normalize, ordered
from cohortlens.plans.analyses import (
    active_counts,
    first_month_counts,
    q02_active_monthly,
    q05_posts_per_user_cohort_time,
    q06_posts_per_user_cohort_utime,
    q08_comment_len_cohort_time,
    q13_ratio_survival,
)
from cohortlens.plans.community import OVERALL, Community

# Series labels of the derived analyses.
ACTIVE_FRACTION_USERS = "Active fraction of users"
ACTIVE_FRACTION_SUBREDDITS = "Active fraction of subreddits"


def _cohort_year_long(c: Community) -> DataFrame:
    cells = c.calendar_cells.where(F.col("n_comments") > 0).withColumn("year", cal_year("cal_month", c.spec))
    g = cells.groupingSets([["year", "u_year"], ["year"]], "year", "u_year").agg(
        ratio(F.sum("sum_comment_size"), F.sum("n_comments")).alias("y"),
        F.grouping("u_year").alias("_overall"),
    )
    return g.select(
        "year",
        F.when(F.col("_overall") == 1, F.lit(OVERALL)).otherwise(F.col("u_year").cast("string")).alias("cohort"),
        "y",
    )


def cohort_year_matrix(c: Community) -> DataFrame:
    """Mean comment length by calendar year x cohort, plus an 'Overall' margin per year,
    in long form (year, cohort, y); all cohorts. One GROUPING SETS aggregation."""
    return _cohort_year_long(c).orderBy("year", "cohort")


def cohort_year_matrix_wide(c: Community) -> DataFrame:
    """The same table as printed in the paper: one row per year, one column per cohort
    (each year x cohort cell holds exactly one value of the long form)."""
    span = c.users.agg(F.min("year"), F.max("year")).first()  # the cohorts that the data has
    cohorts = [str(y) for y in range(span[0], span[1] + 1)] if span[0] is not None else []
    cohorts.append(OVERALL)
    return _cohort_year_long(c).groupBy("year").pivot("cohort", cohorts).agg(F.max("y")).orderBy("year")


def dataset_totals(c: Community) -> DataFrame:
    """One row: raw and clean rows per kind, rows dropped by each cleaning rule (first
    rule that fails), distinct users and distinct (non-NULL) communities."""
    raw = union_raw(c.raw_comments, c.raw_submissions)
    reason = drop_reason("author", "created_utc")
    if c.spec.window is not None:
        start, end = c.spec.window
        outside = (F.col("created_utc") < start) | (F.col("created_utc") >= end)
        reason = F.when(reason.isNull() & outside, F.lit("outside_window")).otherwise(reason)
    r = raw.select("comment", "submission", reason.alias("reason"))
    kept = F.col("reason").isNull()
    totals = r.agg(
        F.sum("comment").cast("long").alias("raw_comments"),
        F.sum("submission").cast("long").alias("raw_submissions"),
        F.count_if(kept & (F.col("comment") == 1)).alias("clean_comments"),
        F.count_if(kept & (F.col("submission") == 1)).alias("clean_submissions"),
        F.count_if(F.col("reason") == "null_time").alias("dropped_null_time"),
        F.count_if(F.col("reason") == "deleted_author").alias("dropped_deleted_author"),
        F.count_if(F.col("reason") == "bot_suffix").alias("dropped_bot_suffix"),
        F.count_if(F.col("reason") == "bot_word").alias("dropped_bot_word"),
    )
    n_users = c.users.agg(F.count(F.lit(1))).scalar()
    n_subs = c.subreddits.agg(F.count("subreddit")).scalar()
    return totals.select("*", n_users.alias("n_users"), n_subs.alias("n_subreddits"))


def active_fraction(c: Community) -> DataFrame:
    """Active authors (communities) in a month over all authors (communities) seen up to
    that month, for every month with activity."""
    new = first_month_counts(c).select(
        F.when(F.col("kind") == "user", "users").otherwise("subreddits").alias("kind"),
        "m",
        F.col("n").alias("new"),
        F.lit(0).cast("long").alias("active"),
    )
    act = active_counts(c).select("kind", "m", F.lit(0).cast("long").alias("new"), F.col("n").alias("active"))
    g = new.unionByName(act).groupBy("kind", "m").agg(F.sum("new").alias("new"), F.sum("active").alias("active"))
    w = Window.partitionBy("kind").orderBy("m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = g.withColumn("seen", F.sum("new").over(w)).where(F.col("active") > 0)
    series = F.when(F.col("kind") == "users", F.lit(ACTIVE_FRACTION_USERS)).otherwise(F.lit(ACTIVE_FRACTION_SUBREDDITS))
    return ordered(as_series(g, calendar_x("m", c.spec), series, ratio("active", "seen")))


def cohort_share(c: Community) -> DataFrame:
    """Per calendar year and cohort: comments and active authors, and each cohort's share
    of the year's total (the weights behind the Overall curves)."""
    cells = c.calendar_cells.withColumn("year", cal_year("cal_month", c.spec))
    per_author = cells.groupBy("year", "u_year", "author").agg(F.sum("n_comments").alias("nc"))
    g = per_author.groupBy("year", "u_year").agg(
        F.sum("nc").cast("long").alias("n_comments"), F.count(F.lit(1)).alias("n_users")
    )
    w = Window.partitionBy("year")
    return g.select(
        "year",
        F.col("u_year").alias("cohort"),
        "n_comments",
        ratio(F.col("n_comments"), F.sum("n_comments").over(w)).alias("comment_share"),
        "n_users",
        ratio(F.col("n_users"), F.sum("n_users").over(w)).alias("user_share"),
    ).orderBy("year", "cohort")


def heavy_authors(c: Community, k: int = 20) -> DataFrame:
    """The k authors with the most raw posts (before cleaning), ties by name, with their
    share of all raw posts.

    The authors of a bounded sketch are counted exactly; where that does not prove the top k, all
    authors are (``operators/heavy.py``). The limit is the report itself."""
    raw = union_raw(c.raw_comments, c.raw_submissions)
    top, total, _ = top_keys(raw.select("author"), "author", k)
    return top.select("author", F.col("n").alias("n_posts"), ratio(F.col("n"), F.lit(total)).alias("share"))


def simpson_check(series: DataFrame) -> DataFrame:
    """Trend (least-squares slope of y over x) of every series against the 'Overall'
    series; ``reversal`` flags cohorts whose trend has the opposite sign."""
    slopes = series.groupBy("series").agg(F.regr_slope("y", "x").alias("slope"))
    overall = slopes.where(F.col("series") == OVERALL).select("slope").scalar()
    trend = F.signum("slope").cast("int")
    overall_trend = F.signum(overall).cast("int")
    return slopes.where(F.col("series") != OVERALL).select(
        "series",
        "slope",
        trend.alias("trend"),
        overall_trend.alias("overall_trend"),
        ((trend * overall_trend) < 0).alias("reversal"),
    )


def simpson_comment_length(c: Community) -> DataFrame:
    """Cohort trends of mean comment length (calendar clock) against the Overall trend."""
    return simpson_check(q08_comment_len_cohort_time(c, order=False))


def simpson_rounded(c: Community, digits: int = 6) -> DataFrame:
    """The same with slopes to ``digits`` places, for comparing engines: their least-squares
    sums differ in the last bits."""
    return simpson_comment_length(c).withColumn("slope", F.round("slope", digits))


def cohort_retention(c: Community) -> DataFrame:
    """Share of each selected cohort's authors active in user month m (overlap window)."""
    spec = c.spec
    act = (
        c.user_cells.where(F.col("u_year").isin(list(spec.selected_cohorts)))
        .groupBy("u_year", "user_month")
        .agg(F.count(F.lit(1)).alias("active"))
        .where(F.col("user_month") <= F.lit(12) * (F.lit(spec.end_year) - F.col("u_year")))
    )
    sizes = c.users.groupBy(F.col("year").alias("u_year")).agg(F.count(F.lit(1)).alias("size"))
    g = act.join(sizes, "u_year")
    return ordered(as_series(g, user_x("user_month"), F.col("u_year"), ratio("active", "size")))


def survival_distribution(c: Community) -> DataFrame:
    """Authors per cohort and survival bucket, and the bucket's share of the cohort."""
    g = c.users.groupBy(F.col("year").alias("cohort"), "survival").agg(F.count(F.lit(1)).alias("n_users"))
    w = Window.partitionBy("cohort")
    return g.select(
        "cohort", "survival", "n_users", ratio(F.col("n_users"), F.sum("n_users").over(w)).alias("share")
    ).orderBy("cohort", "survival")


def low_activity_survivors(c: Community, k: int = 2) -> DataFrame:
    """Per cohort, among authors active for at least a year (survival >= 1): how many
    post at most ``k`` times per active calendar month on average."""
    per_author = (
        c.calendar_cells.where(F.col("u_survival") >= 1)
        .groupBy("author", "u_year")
        .agg(F.sum("n_posts").alias("n"), F.count(F.lit(1)).alias("months"))
    )
    low = F.col("n") <= F.lit(k) * F.col("months")
    g = per_author.groupBy(F.col("u_year").alias("cohort")).agg(
        F.count(F.lit(1)).alias("n_survivors"), F.count_if(low).alias("n_low")
    )
    return g.select("cohort", "n_survivors", "n_low", ratio("n_low", "n_survivors").alias("share_low")).orderBy(
        "cohort"
    )


def low_activity_months(c: Community, k: int = 2) -> DataFrame:
    """Per cohort and survival, among authors active for at least a year: in how many of
    their active calendar months they post at most ``k`` times."""
    g = (
        c.calendar_cells.where(F.col("u_survival") >= 1)
        .groupBy(F.col("u_year").alias("cohort"), F.col("u_survival").alias("survival"))
        .agg(F.count(F.lit(1)).alias("n_months"), F.count_if(F.col("n_posts") <= F.lit(k)).alias("n_low"))
    )
    return g.select("cohort", "survival", "n_months", "n_low", ratio("n_low", "n_months").alias("share_low")).orderBy(
        "cohort", "survival"
    )


def initial_level_by_survival(c: Community) -> DataFrame:
    """The three measures in each author's first user month, by cohort and survival."""
    g = (
        c.user_cells.where(F.col("user_month") == 0)
        .groupBy(F.col("u_year").alias("cohort"), F.col("u_survival").alias("survival"))
        .agg(
            ratio(F.sum("n_posts"), F.count(F.lit(1))).alias("posts_per_user"),
            ratio(F.sum("sum_comment_size"), F.sum("n_comments")).alias("comment_length"),
            ratio(F.sum("n_comments"), F.sum("n_submissions")).alias("comments_per_submission"),
        )
    )
    return g.orderBy("cohort", "survival")


def first_year_growth(series: DataFrame) -> DataFrame:
    """Per (cohort,) series: y at user month 12 over y at user month 0."""
    keys = [k for k in ("cohort", "series") if k in series.columns]
    g = series.groupBy(*keys).agg(
        F.max(F.when(F.col("month") == 0, F.col("y"))).alias("y0"),
        F.max(F.when(F.col("month") == 12, F.col("y"))).alias("y12"),
    )
    return g.select(*keys, "y0", "y12", F.try_divide(F.col("y12"), F.col("y0")).alias("growth")).orderBy(*keys)


def first_year_growth_ratio(c: Community) -> DataFrame:
    """Comments per submission: growth over the first year, by cohort and survival."""
    return first_year_growth(q13_ratio_survival(c, order=False, keep_month=True))


def entry_vs_prior_overall(c: Community) -> DataFrame:
    """Mean comment length of each cohort in its first month against the Overall value
    of the month before (calendar clock)."""
    q = q08_comment_len_cohort_time(c, order=False, keep_month=True)
    entry = (
        q.where(F.col("series") != OVERALL)
        .groupBy("series")
        .agg(F.min("month").alias("month"), F.min_by("y", "month").alias("y_entry"))
    )
    prior = q.where(F.col("series") == OVERALL).select(
        (F.col("month") + 1).alias("month"), F.col("y").alias("y_prior_overall")
    )
    j = entry.join(prior, "month", "left")
    return j.select(
        "series",
        calendar_x("month", c.spec).alias("x"),
        "y_entry",
        "y_prior_overall",
        (F.col("y_entry") - F.col("y_prior_overall")).alias("diff"),
    ).orderBy("series")


def cumulative_share(c: Community) -> DataFrame:
    """Cumulative users / communities as a share of their final total."""
    from cohortlens.plans.analyses import q01_cumulative_growth

    return q01_cumulative_growth(c, share=True)


def normalize_sum(c: Community) -> DataFrame:
    """Active users / communities per month, each divided by its series total."""
    return ordered(normalize(q02_active_monthly(c), "sum"))


def normalize_max(c: Community) -> DataFrame:
    """Posts per user by cohort (calendar clock), each series divided by its maximum."""
    return ordered(normalize(q05_posts_per_user_cohort_time(c), "y"))


def normalize_x(c: Community) -> DataFrame:
    """Posts per user by cohort (user clock), x divided by the series' last x."""
    return ordered(normalize(q06_posts_per_user_cohort_utime(c), "x"))


def active_approx(c: Community, rsd: float = 0.05) -> DataFrame:
    """Active users / communities per month with HyperLogLog++ distinct counts."""
    return q02_active_monthly(c, approx_rsd=rsd)


def active_approx_check(c: Community, rsd: float = 0.05) -> DataFrame:
    """The exact active counts, and whether the approximate ones are ``within`` three
    relative standard deviations of them (or within two, where that is less than two)."""
    approx = active_approx(c, rsd).select("x", "series", F.col("y").alias("approx"))
    close = F.abs(F.col("approx") - F.col("y")) <= F.greatest(F.lit(2.0), 3 * rsd * F.col("y"))
    return q02_active_monthly(c).join(approx, ["x", "series"], "left").select("x", "series", "y", F.coalesce(close, F.lit(False)).alias("within"))


DERIVED = {
    "cohort_year_matrix": cohort_year_matrix,
    "cohort_year_matrix_wide": cohort_year_matrix_wide,
    "dataset_totals": dataset_totals,
    "active_fraction": active_fraction,
    "cohort_share": cohort_share,
    "heavy_authors": heavy_authors,
    "simpson_check": simpson_rounded,
    "cohort_retention": cohort_retention,
    "survival_distribution": survival_distribution,
    "low_activity_survivors": low_activity_survivors,
    "low_activity_months": low_activity_months,
    "initial_level_by_survival": initial_level_by_survival,
    "first_year_growth": first_year_growth_ratio,
    "entry_vs_prior_overall": entry_vs_prior_overall,
    "cumulative_share": cumulative_share,
    "normalize_sum": normalize_sum,
    "normalize_max": normalize_max,
    "normalize_x": normalize_x,
    "active_approx": active_approx_check,
}
