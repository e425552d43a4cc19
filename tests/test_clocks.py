"""Clock, cohort and survival boundaries (integer bins that truncate)."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.clocks import cal_month, cohort_year, epoch_seconds, idiv, survival_years, user_month
from cohortlens.operators.dims import users_dim
from cohortlens.spec import MONTH_S, REDDIT, YEAR_S

O = REDDIT.origin


def _one(spark, expr, value):
    return spark.range(1).select(expr(F.lit(value)).alias("v")).first().v


def test_idiv_truncates_toward_zero(spark):
    got = spark.range(1).select(idiv(F.lit(-7), 2).alias("a"), idiv(F.lit(7), 2).alias("b")).first()
    assert (got.a, got.b) == (-3, 3)


@pytest.mark.parametrize("offset,expected", [(MONTH_S - 1, 0), (MONTH_S, 1), (0, 0)])
def test_user_month_boundary(spark, offset, expected):
    v = spark.range(1).select(user_month(F.lit(O + offset), F.lit(O), REDDIT).alias("v")).first().v
    assert v == expected


@pytest.mark.parametrize("offset,expected", [(YEAR_S - 1, 2007), (YEAR_S, 2008)])
def test_cohort_boundary(spark, offset, expected):
    assert _one(spark, lambda c: cohort_year(c, REDDIT), O + offset) == expected


@pytest.mark.parametrize("active,expected", [(YEAR_S - 1, 0), (YEAR_S, 1), (0, 0)])
def test_survival_boundary(spark, active, expected):
    assert _one(spark, lambda c: survival_years(c, REDDIT), active) == expected


def test_calendar_month(spark):
    assert _one(spark, lambda c: cal_month(c, REDDIT), O + 12 * MONTH_S) == 12


def test_gregorian_cohort(spark):
    greg = replace(REDDIT, calendar="gregorian")
    # 2007-12-31 23:00 UTC is Julian year 2007 and calendar year 2007; 2008-12-31 20:00 UTC
    # is already Julian year 2009 (years of 365.25 days drift) but calendar year 2008
    assert _one(spark, lambda c: cohort_year(c, greg), 1199142000) == 2007
    assert _one(spark, lambda c: cohort_year(c, greg), 1230753600) == 2008
    assert _one(spark, lambda c: cohort_year(c, REDDIT), 1230753600) == 2009


def test_epoch_seconds_ignores_session_time_zone(spark):
    df = spark.range(1).select(F.lit("2001-02-03 04:05:06").cast("timestamp_ntz").alias("t"))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        a = df.select(epoch_seconds("t").alias("v")).first().v
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert a == 981173106


def test_single_post_user(spark):
    posts = spark.createDataFrame([(5, "u", O + 100, "s", 1, 0)], "body_size long, author string, created_utc long, subreddit string, comment int, submission int")
    u = users_dim(posts, REDDIT).first()
    assert (u.time_active, u.survival, u.year, u.n_posts) == (0, 0, 2007, 1)


def test_gregorian_calendar_clock(spark):
    from cohortlens.functions.clocks import cal_year

    greg = replace(REDDIT, calendar="gregorian")
    t = 1230753600  # 2008-12-31 20:00 UTC
    row = spark.range(1).select(
        cal_month(F.lit(t), greg).alias("g"),
        cal_month(F.lit(t), REDDIT).alias("j"),
        cal_year(cal_month(F.lit(t), greg), greg).alias("gy"),
        cal_year(cal_month(F.lit(t), REDDIT), REDDIT).alias("jy"),
    ).first()
    assert (row.g, row.gy) == (23, 2008)  # December of the second year
    assert (row.j, row.jy) == (24, 2009)  # already past two Julian years
    # the first second of a calendar month starts a new month
    assert _one(spark, lambda c: cal_month(c, greg), 1201824000) == 13  # 2008-02-01 00:00 UTC
    assert _one(spark, lambda c: cal_month(c, greg), 1201823999) == 12


def test_gregorian_community_runs(spark):
    from cohortlens.plans.community import Community
    from cohortlens.sources.files import RAW_COMMENT_SCHEMA, RAW_SUBMISSION_SCHEMA

    greg = replace(REDDIT, calendar="gregorian", window=None)
    rows_ = [("ab", "u1", 1230753600, "s"), ("abcd", "u1", 1230768000, "s"), ("a", "u2", 1230768000, "s")]
    c = Community(
        spark.createDataFrame(rows_, RAW_COMMENT_SCHEMA), spark.createDataFrame([], RAW_SUBMISSION_SCHEMA), greg
    )
    users = {r.author: r.year for r in c.users.collect()}
    assert users == {"u1": 2008, "u2": 2009}
    got = {(r.series, round((r.x - 2007) * 12)): r.y for r in c.metric("comment_length", "calendar", "cohort", overall=True, cohorts=(2008, 2009)).collect()}
    assert got == {("2008", 23): 2.0, ("2008", 24): 4.0, ("2009", 24): 1.0, ("Overall", 23): 2.0, ("Overall", 24): 2.5}


def test_shuffle_partitions_for():
    from cohortlens.session import TARGET_PARTITION_BYTES, shuffle_partitions_for

    assert shuffle_partitions_for(10, cores=8) == 8
    assert shuffle_partitions_for(100 * 2**40, cores=8000) == 100 * 2**40 // TARGET_PARTITION_BYTES  # 100 TiB
    assert shuffle_partitions_for(TARGET_PARTITION_BYTES * 10 + 1, cores=2) == 11
