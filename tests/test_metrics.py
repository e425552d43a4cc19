"""Measures on hand-written communities, and the cell rewrite against the direct form."""

import pytest
from pyspark.sql import functions as F

from cohortlens.plans.analyses import ANALYSES, q01_cumulative_growth
from cohortlens.plans.community import Community
from cohortlens.sources.files import RAW_COMMENT_SCHEMA, RAW_SUBMISSION_SCHEMA
from cohortlens.spec import MONTH_S, REDDIT, YEAR_S
from tests.conftest import rows

O = REDDIT.origin
Y2008 = O + YEAR_S  # start of cohort 2008
END_REACH = 12 * (REDDIT.end_year - 2008)  # last user month kept by the overlap filter


def _community(spark, comments, submissions=(), **kw):
    c = spark.createDataFrame(list(comments), RAW_COMMENT_SCHEMA)
    s = spark.createDataFrame(list(submissions), RAW_SUBMISSION_SCHEMA)
    return Community(c, s, REDDIT.with_window(None, None), **kw)


def test_null_subreddit_counts_in_users_not_in_measures(spark):
    c = _community(
        spark,
        [("abc", "u1", Y2008, None), ("abcd", "u1", Y2008 + MONTH_S, "s1")],
    )
    u = c.users.first()
    assert u.min_created_utc == Y2008  # the NULL-community post still defines the first post
    got = rows(c.metric("posts_per_user", "user", "cohort", overlap=True), "x", "y")
    assert got == [(1 / 12, 1.0)]  # only the second post, in user month 1


def test_no_submissions_gives_null_ratio(spark):
    c = _community(spark, [("a", "u1", Y2008, "s"), ("b", "u1", Y2008 + 10, "s")])
    got = c.metric("comments_per_submission", "calendar", "cohort", overall=True).collect()
    assert {r.series for r in got} == {"2008", "Overall"}
    assert all(r.y is None for r in got)


def test_overlap_edge_is_inclusive(spark):
    kept = Y2008 + END_REACH * MONTH_S
    dropped = Y2008 + (END_REACH + 1) * MONTH_S
    c = _community(spark, [("a", "u1", Y2008, "s"), ("a", "u1", kept, "s"), ("a", "u1", dropped, "s")])
    months = sorted(round(r.x * 12) for r in c.metric("posts_per_user", "user", "cohort", overlap=True).collect())
    assert months == [0, END_REACH]
    strict = c.metric("posts_per_user", "user", "cohort", overlap=True, strict=True).collect()
    assert sorted(round(r.x * 12) for r in strict) == [0]


def test_gap_in_series_has_no_row_and_cumulative_carries_on(spark):
    c = _community(
        spark,
        [("a", "u1", Y2008, "s"), ("a", "u2", Y2008 + 3 * MONTH_S, "s")],
    )
    users = [r for r in q01_cumulative_growth(c).collect() if "users" in r.series]
    assert [(round((r.x - 2007) * 12), r.y) for r in users] == [(12, 1.0), (15, 2.0)]


def test_comment_length_counts_null_sizes_in_denominator(spark):
    c = _community(spark, [("abcd", "u1", Y2008, "s"), (None, "u1", Y2008 + 5, "s")])
    got = c.metric("comment_length", "calendar").first()
    assert got.y == 2.0  # 4 characters over 2 comments, not over 1


def test_survival_split(spark):
    c = _community(
        spark,
        [
            ("a", "short", Y2008, "s"),
            ("a", "long", Y2008, "s"),
            ("a", "long", Y2008 + YEAR_S + 5, "s"),
        ],
    )
    got = rows(c.metric("posts_per_user", "user", "survival", cohorts=(2008,)), "cohort", "series", "x", "y")
    assert got == [(2008, "0", 0.0, 1.0), (2008, "1", 0.0, 1.0), (2008, "1", 1.0, 1.0)]


CONFIGS = [
    ("posts_per_user", "calendar", None, {}),
    ("posts_per_user", "user", None, {"max_user_month": 72}),
    ("posts_per_user", "calendar", "cohort", {"overall": True}),
    ("comment_length", "calendar", "cohort", {"overall": True}),
    ("comments_per_submission", "calendar", "cohort", {"overall": True, "overall_scope": "selected"}),
    ("posts_per_user", "user", "cohort", {"overlap": True}),
    ("comment_length", "user", "cohort", {"overlap": True}),
    ("comments_per_submission", "user", "cohort", {"overlap": True}),
    ("posts_per_user", "user", "survival", {"cohorts": (1996, 1997, 1998, 1999, 2000)}),
    ("comment_length", "user", "survival", {"cohorts": (1998, 1999, 2000)}),
    ("comments_per_submission", "user", "survival", {"cohorts": (1996, 1997, 1998, 1999)}),
]


@pytest.mark.parametrize("measure,clock,by,kw", CONFIGS)
def test_cells_equal_direct(small_community, measure, clock, by, kw):
    cells = small_community.metric(measure, clock, by, **kw)
    direct = small_community.metric(measure, clock, by, method="direct", **kw)
    assert rows(cells) == rows(direct)
    assert cells.count() > 0


def test_skew_safe_and_plain_join_agree(spark):
    from tests.conftest import SMALL

    a = Community.from_fixture(spark, SMALL, skew_safe=True)
    b = Community.from_fixture(spark, SMALL, skew_safe=False)
    assert rows(ANALYSES["q12_ratio_cohort_utime"](a)) == rows(ANALYSES["q12_ratio_cohort_utime"](b))


def test_materialized_equals_lazy(spark):
    from tests.conftest import SMALL

    a = Community.from_fixture(spark, SMALL, materialize=True)
    b = Community.from_fixture(spark, SMALL)
    for name in ("q03_posts_per_user_time", "q09_comment_len_cohort_utime", "q11_ratio_cohort_time"):
        assert rows(ANALYSES[name](a)) == rows(ANALYSES[name](b)), name
    assert a.calendar_cells.where(F.col("n_posts") <= 0).count() == 0


def test_series_order_is_numeric(spark):
    from cohortlens.operators.series import ordered

    df = spark.createDataFrame(
        [(0.0, s, 1.0) for s in ("10", "9", "Overall", "2", "Cumulative")], "x double, series string, y double"
    )
    assert [r.series for r in ordered(df).collect()] == ["2", "9", "10", "Cumulative", "Overall"]


def test_dimensions_from_cells_equal_direct(small_community):
    from cohortlens.operators.dims import subreddits_dim, users_dim

    c = small_community
    assert rows(c.users) == rows(users_dim(c.posts, c.spec).select(*c.users.columns))
    assert rows(c.subreddits) == rows(subreddits_dim(c.posts).select(*c.subreddits.columns))


def test_axis_labels(small_community):
    from cohortlens.plans.analyses import AXIS_LABELS, with_axis_labels

    assert set(AXIS_LABELS) == set(ANALYSES)
    df = with_axis_labels(ANALYSES["q09_comment_len_cohort_utime"](small_community), "q09_comment_len_cohort_utime", display=True)
    assert df.columns == ["Time in user referential", "series", "Average comment length"]


def test_persisted_equals_lazy(spark):
    from tests.conftest import SMALL

    a = Community.from_fixture(spark, SMALL, persist=True)
    b = Community.from_fixture(spark, SMALL)
    for name in ("q01_cumulative_growth", "q07_posts_per_user_survival", "q11_ratio_cohort_time"):
        assert rows(ANALYSES[name](a)) == rows(ANALYSES[name](b)), name
    assert a.user_cells.is_cached and a.posts.is_cached


def test_normalize_and_cumulative_share(spark):
    from cohortlens.operators.series import cumulative, normalize

    df = spark.createDataFrame(
        [(1.0, "a", 1.0), (2.0, "a", 3.0), (4.0, "a", 4.0), (1.0, "b", 2.0), (2.0, "b", 2.0)],
        "x double, series string, y double",
    )
    xs = {(r.series, r.x, r.y) for r in normalize(df, "x,sum").collect()}
    assert xs == {("a", 0.25, 0.125), ("a", 0.5, 0.375), ("a", 1.0, 0.5), ("b", 0.5, 0.5), ("b", 1.0, 0.5)}
    ys = {(r.series, r.x, r.y) for r in normalize(df, "y").collect()}
    assert ys == {("a", 1.0, 0.25), ("a", 2.0, 0.75), ("a", 4.0, 1.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0)}
    cs = {(r.series, r.x, r.y) for r in cumulative(df, share=True).collect()}
    assert cs == {("a", 1.0, 0.125), ("a", 2.0, 0.5), ("a", 4.0, 1.0), ("b", 1.0, 0.5), ("b", 2.0, 1.0)}
