"""Cleaning rules on hand-written edge rows."""

from cohortlens.operators.clean import clean_comments, clean_posts, clean_submissions, window_filter
from cohortlens.sources.files import RAW_COMMENT_SCHEMA, RAW_SUBMISSION_SCHEMA

T = 1_200_000_000


def _comments(spark, authors, body="hello", created=T, sub="s"):
    return spark.createDataFrame([(body, a, created, sub) for a in authors], RAW_COMMENT_SCHEMA)


def test_dropped_and_kept_authors(spark):
    dropped = ["[deleted]", None, "x_bot", "xBot", "aTRANSCRIBERb", "autoModerator", "AutoModerator7"]
    kept = ["xBOT", "xbot", "Bot1", "ABot1", "_bot1", "[Deleted]", "user_9bot", "bot", "Bo"]
    out = clean_comments(_comments(spark, dropped + kept)).collect()
    assert sorted(r.author for r in out) == sorted(kept)


def test_null_time_dropped(spark):
    raw = spark.createDataFrame([("a", "u1", None, "s"), ("b", "u2", T, "s")], RAW_COMMENT_SCHEMA)
    assert [r.author for r in clean_comments(raw).collect()] == ["u2"]


def test_null_body_kept_with_null_size(spark):
    raw = spark.createDataFrame([(None, "u1", T, "s"), ("abcd", "u2", T, "s")], RAW_COMMENT_SCHEMA)
    got = {r.author: r.body_size for r in clean_comments(raw).collect()}
    assert got == {"u1": None, "u2": 4}


def test_submission_size_null_if_any_part_null(spark):
    raw = spark.createDataFrame(
        [("title", None, "u1", T, "s"), ("ab", "cde", "u2", T, "s")], RAW_SUBMISSION_SCHEMA
    )
    got = {r.author: (r.body_size, r.comment, r.submission) for r in clean_submissions(raw).collect()}
    assert got == {"u1": (None, 0, 1), "u2": (5, 0, 1)}


def test_posts_union_flags(spark):
    c = _comments(spark, ["u1"])
    s = spark.createDataFrame([("t", "x", "u1", T, "s")], RAW_SUBMISSION_SCHEMA)
    got = sorted((r.comment, r.submission) for r in clean_posts(c, s).collect())
    assert got == [(0, 1), (1, 0)]


def test_window_filter_half_open(spark):
    raw = spark.createDataFrame(
        [("a", "u", t, "s") for t in (99, 100, 150, 199, 200)], RAW_COMMENT_SCHEMA
    )
    got = sorted(r.created_utc for r in window_filter(clean_comments(raw), 100, 200).collect())
    assert got == [100, 150, 199]


def test_cleaning_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "raw")
    _comments(spark, ["u1", "[deleted]"]).write.parquet(path)
    plan = clean_comments(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1]
    for f in ("IsNotNull(created_utc)", "IsNotNull(author)", "Not(EqualTo(author,[deleted]))", "Not(StringEndsWith("):
        assert f in pushed
