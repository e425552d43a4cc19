"""Structural invariants of the published curves, checked on the fixture community."""

from collections import defaultdict

from pyspark.sql import functions as F

from cohortlens.plans.analyses import ANALYSES, q01_cumulative_growth, q02_active_monthly
from cohortlens.plans.derived import simpson_check


def test_overlap_bounds_points_per_cohort(small_community):
    spec = small_community.spec
    q6 = ANALYSES["q06_posts_per_user_cohort_utime"](small_community).collect()
    per = defaultdict(list)
    for r in q6:
        per[int(r.series)].append(round(r.x * 12))
    for cohort, months in per.items():
        assert max(months) <= 12 * (spec.end_year - cohort)
        assert len(months) <= 12 * (spec.end_year - cohort) + 1


def test_survival_bucket_month_range(small_community):
    q7 = ANALYSES["q07_posts_per_user_survival"](small_community).collect()
    for r in q7:
        # an author who survived k whole years has posts only in user months < 12*(k+1)
        assert round(r.x * 12) < 12 * (int(r.series) + 1)


def test_q3_equals_q5_overall(small_community):
    q3 = {r.x: r.y for r in ANALYSES["q03_posts_per_user_time"](small_community).collect()}
    q5 = {r.x: r.y for r in ANALYSES["q05_posts_per_user_cohort_time"](small_community).collect() if r.series == "Overall"}
    assert q3 == q5


def test_overall_is_a_weighted_mean_of_all_cohorts(small_community):
    spec = small_community.spec
    every = tuple(range(spec.base_year, spec.end_year + 1))
    q = small_community.metric("comment_length", "calendar", "cohort", overall=True, cohorts=every).collect()
    by_x = defaultdict(dict)
    for r in q:
        by_x[r.x][r.series] = r.y
    for x, ys in by_x.items():
        cohorts = [v for k, v in ys.items() if k != "Overall" and v is not None]
        if ys.get("Overall") is not None and cohorts:
            assert min(cohorts) - 1e-9 <= ys["Overall"] <= max(cohorts) + 1e-9


def test_cumulative_ends_at_dimension_sizes_and_bounds_active(small_community):
    c = small_community
    cum = q01_cumulative_growth(c).collect()
    users = [r.y for r in cum if "users" in r.series]
    subs = [r.y for r in cum if "subreddits" in r.series]
    assert users == sorted(users) and subs == sorted(subs)
    assert users[-1] == c.users.count()
    assert subs[-1] == c.subreddits.count()  # includes the NULL community row
    seen = {(("users" in r.series), r.x): r.y for r in cum}
    for r in q02_active_monthly(c).collect():
        is_user = "users" in r.series
        before = [y for (u, x), y in seen.items() if u == is_user and x <= r.x]
        assert r.y <= max(before)


def test_first_user_month_at_most_cohort_size(small_community):
    c = small_community
    sizes = {r.year: r["count"] for r in c.users.groupBy("year").count().collect()}
    act = c.user_cells.where(F.col("user_month") == 0).groupBy("u_year").count().collect()
    for r in act:
        assert r["count"] <= sizes[r.u_year]


def test_simpson_reversal_flagged(spark):
    # two cohorts whose mean rises over time, while the mix shifts to the low cohort
    data = []
    for x, (a_len, a_n, b_len, b_n) in enumerate([(200, 9, 100, 1), (210, 5, 110, 5), (220, 1, 120, 9)]):
        data += [(float(x), "A", float(a_len), a_n), (float(x), "B", float(b_len), b_n)]
    df = spark.createDataFrame(data, "x double, series string, y double, n long")
    overall = df.groupBy("x").agg((F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("y")).select(
        "x", F.lit("Overall").alias("series"), "y"
    )
    series = df.select("x", "series", "y").unionByName(overall)
    got = {r.series: (r.trend, r.overall_trend, r.reversal) for r in simpson_check(series).collect()}
    assert got == {"A": (1, -1, True), "B": (1, -1, True)}


def test_overall_scopes(small_community):
    c = small_community
    # Q11: the Overall line covers exactly the months of the selected cohorts
    q11 = ANALYSES["q11_ratio_cohort_time"](c).collect()
    overall = {r.x for r in q11 if r.series == "Overall"}
    cohorts = {r.x for r in q11 if r.series != "Overall"}
    assert overall == cohorts
    # Q5 / Q8: the Overall line spans all authors, so it covers every cohort month and
    # also months before the first selected cohort starts
    q5 = ANALYSES["q05_posts_per_user_cohort_time"](c).collect()
    overall5 = {r.x for r in q5 if r.series == "Overall"}
    cohorts5 = {r.x for r in q5 if r.series != "Overall"}
    assert cohorts5 < overall5
    assert min(overall5) < min(cohorts5)
