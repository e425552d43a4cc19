"""A community extended by new shards equals the one built from everything."""

import pytest
from pyspark.sql import functions as F

from cohortlens.plans.community import Community
from cohortlens.plans.incremental import extended
from cohortlens.sources.files import shard_year
from tests.conftest import rows

TABLES = ("posts", "month_cells", "users", "subreddits", "calendar_cells", "user_cells")


def split(c, first):
    early = F.coalesce(shard_year("created_utc", c.spec) < first, F.lit(False))
    return ((c.raw_comments.where(x), c.raw_submissions.where(x)) for x in (early, ~early))


@pytest.mark.parametrize("skew", [{"skew_safe": False}, {"rows_per_task": 50}])
def test_later_shards(small_community, skew):
    old, new = split(small_community, 1998)
    got = extended(Community(*old, small_community.spec, materialize=True, **skew), *new)
    for name in TABLES:
        want = getattr(small_community, name)
        assert rows(getattr(got, name), *want.columns) == rows(want), name


def test_earlier_shards_move_first_posts(small_community):
    new, old = split(small_community, 1998)
    start = Community(*old, small_community.spec, materialize=True, rows_per_task=50)
    got = extended(start, *new)
    moved = got.users.join(start.users.select("author", F.col("min_created_utc").alias("was")), "author").where("min_created_utc < was")
    assert moved.count() > 10
    for name in TABLES:
        want = getattr(small_community, name)
        assert rows(getattr(got, name), *want.columns) == rows(want), name


def test_old_posts_are_not_scanned_when_nobody_moves(small_community):
    """The old posts fail as soon as a task reads one."""
    old, new = split(small_community, 1998)
    start = Community(*old, small_community.spec, materialize=True).build()
    before = start.posts.count()
    start.__dict__["posts"] = start.posts.where(F.raise_error(F.lit("old posts were read")).cast("boolean"))
    got = extended(start, *new)
    assert before > 0 and rows(got.user_cells) == rows(small_community.user_cells) and rows(got.users) == rows(small_community.users)
    with pytest.raises(Exception, match="old posts were read"):
        got.posts.count()


def test_nothing_added(small_community):
    nothing = small_community.raw_comments.where("false"), small_community.raw_submissions.where("false")
    got = extended(small_community, *nothing)
    assert rows(got.user_cells) == rows(small_community.user_cells) and rows(got.calendar_cells) == rows(small_community.calendar_cells)


def test_metrics_of_an_extended_community(small_community):
    old, new = split(small_community, 1999)
    got = extended(Community(*old, small_community.spec, materialize=True), *new)
    for measure, clock, by in (("posts_per_user", "calendar", "cohort"), ("comment_length", "user", "survival")):
        assert rows(got.metric(measure, clock, by)) == rows(small_community.metric(measure, clock, by))
