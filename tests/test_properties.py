"""Property tests: random communities, with heavy keys salted, give the same results in
the cell form and in the direct COUNT DISTINCT form."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortlens.plans.community import Community
from cohortlens.sources.files import RAW_COMMENT_SCHEMA, RAW_SUBMISSION_SCHEMA
from cohortlens.spec import MONTH_S, REDDIT, YEAR_S
from tests.conftest import rows

O = REDDIT.origin
AUTHORS = ["a", "b", "c", "d", "[deleted]", None, "x_bot", "yBot", "zbot", "AutoModeratorQ"]
SUBS = ["s1", "s2", "s3", None]
# posts from a year before the origin's second year to the end of observation
TIMES = st.integers(min_value=O, max_value=O + 8 * YEAR_S - 1)

comment = st.tuples(st.one_of(st.none(), st.text("ab", max_size=30)), st.sampled_from(AUTHORS), TIMES, st.sampled_from(SUBS))
submission = st.tuples(
    st.sampled_from(["t", "title"]),
    st.one_of(st.none(), st.text("xy", max_size=20)),
    st.sampled_from(AUTHORS),
    TIMES,
    st.sampled_from(SUBS),
)


def _near_month_edges(t):
    # pull some timestamps onto exact month boundaries of the user clock
    return t - (t - O) % MONTH_S if t % 3 == 0 else t


CONFIGS = [
    ("posts_per_user", "calendar", "cohort", {"overall": True}),
    ("comment_length", "user", "cohort", {"overlap": True}),
    ("comments_per_submission", "user", "survival", {"cohorts": tuple(range(2007, 2015))}),
    ("posts_per_user", "user", None, {"max_user_month": 72}),
]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(comment, min_size=1, max_size=60), st.lists(submission, max_size=30))
def test_cells_equal_direct_with_salting(spark, comments, submissions):
    comments = [(b, a, _near_month_edges(t), s) for b, a, t, s in comments]
    c_raw = spark.createDataFrame(comments, RAW_COMMENT_SCHEMA)
    s_raw = spark.createDataFrame(submissions, RAW_SUBMISSION_SCHEMA)
    spec = REDDIT.with_window(None, None)
    # rows_per_task=2 makes almost every author "hot" and spreads it over salts
    salted = Community(c_raw, s_raw, spec, rows_per_task=2, max_hot=100)
    plain = Community(c_raw, s_raw, spec, skew_safe=False)
    for measure, clock, by, kw in CONFIGS:
        a = rows(salted.metric(measure, clock, by, **kw))
        b = rows(plain.metric(measure, clock, by, method="direct", **kw))
        assert a == b, (measure, clock, by)
