"""Time model of a cohort study.

Every post is placed on two clocks:

* the calendar clock: ``cal_month = (created_utc - origin) div month_s``
* the user clock: ``user_month = (created_utc - first_post) div month_s``

and every author gets a cohort (``u_year``) from the year of their first post and a
survival bucket from ``(last_post - first_post) div year_s``.

Years are 365.25 days and months a twelfth of that, both whole numbers of seconds, so
all bins are integer divisions that truncate (never floating point, never rounding).
Month indices are kept as integers for grouping; the chart ``x`` value is derived from
them only in the final projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Length of a Julian year and of a twelfth of it, in seconds.
YEAR_S = 31557600
MONTH_S = 2629800


@dataclass(frozen=True)
class CohortSpec:
    origin: int  # epoch seconds of the start of base_year (UTC)
    base_year: int  # calendar label of cal_month 0 and of cohort index 0
    end_year: int  # last year of observation; overlap filter is user_month <= 12*(end_year-cohort)
    first_cohort: int  # first selected cohort (inclusive)
    last_cohort: int  # last selected cohort (inclusive)
    year_s: int = YEAR_S
    month_s: int = MONTH_S
    # "julian": cohort = base_year + (first - origin) div year_s and calendar months are
    # 30.4375-day bins (what the analyses use); "gregorian": cohort = UTC calendar year of
    # the first post and the calendar clock counts UTC calendar months. The user clock is
    # a duration in 30.4375-day months in both.
    calendar: str = "julian"
    # cohorts split by survival in the posts-per-user and comment-length analyses
    survival_cohorts: tuple[int, ...] = ()
    # cohorts split by survival in the comments-per-submission analysis
    ratio_survival_cohorts: tuple[int, ...] = ()
    # user-clock cap of the overall posts-per-user curve, in months (6 years)
    max_user_month: int = 72
    # observation window [start, end) in epoch seconds; None keeps everything
    window: tuple[int, int] | None = None
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    def year_start(self, year: int) -> int:
        """Epoch seconds where the Julian year ``year`` starts on this spec's clock."""
        return self.origin + (year - self.base_year) * self.year_s

    @property
    def selected_cohorts(self) -> tuple[int, ...]:
        return tuple(range(self.first_cohort, self.last_cohort + 1))

    def with_window(self, start: int | None, end: int | None) -> "CohortSpec":
        return replace(self, window=None if start is None else (start, end))


# The published study of a large discussion site (data from Oct 2007 to Dec 2014,
# cohorts 2008..2013, survival splits for 2010..2012 and 2008..2011).
REDDIT = CohortSpec(
    origin=1167609600,  # 2007-01-01 00:00:00 UTC
    base_year=2007,
    end_year=2014,
    first_cohort=2008,
    last_cohort=2013,
    survival_cohorts=(2010, 2011, 2012),
    ratio_survival_cohorts=(2008, 2009, 2010, 2011),
    window=(1191196800, 1420070400),  # 2007-10-01 .. 2015-01-01
)

# The community derived from the driver's order tables (see sources/fixture.py):
# same shape as REDDIT, shifted to 1995..2001.
FIXTURE = CohortSpec(
    origin=788918400,  # 1995-01-01 00:00:00 UTC
    base_year=1995,
    end_year=2001,
    first_cohort=1996,
    last_cohort=2000,
    survival_cohorts=(1998, 1999, 2000),
    ratio_survival_cohorts=(1996, 1997, 1998, 1999),
)
