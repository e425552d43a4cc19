"""Column expressions for the two clocks, cohorts and survival buckets.

All helpers return plain Catalyst expressions (no Python UDF), so they stay inside
whole-stage codegen and can be folded/pushed like any other built-in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.spec import CohortSpec

SECONDS_PER_DAY = 86400


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(c: str | Column, k: int) -> Column:
    """Integer division that truncates toward zero, like SQL ``a div k``.

    Computed as a double quotient cast back to long: exact for |a| < 2**53, because a
    non-integer quotient is at least 1/k away from the next integer while the double
    error is below |a/k| * 2**-53.
    """
    return (_col(c) / F.lit(k)).cast("long")


def epoch_seconds(ts: str | Column) -> Column:
    """Epoch seconds of a TIMESTAMP_NTZ (wall clock read as UTC), independent of the
    session time zone: days since 1970-01-01 plus the time of day."""
    t = _col(ts)
    return (
        F.unix_date(t.cast("date")).cast("long") * SECONDS_PER_DAY
        + F.hour(t) * 3600
        + F.minute(t) * 60
        + F.second(t)
    )


def _utc_date(epoch: Column) -> Column:
    return F.date_from_unix_date(F.floor(epoch / F.lit(SECONDS_PER_DAY)).cast("int"))


def cal_month(created: str | Column, spec: CohortSpec) -> Column:
    """Calendar month index counted from the start of ``base_year``.

    julian:    30.4375-day bins from the spec origin (what the analyses use);
    gregorian: UTC calendar months, (year - base_year) * 12 + month - 1.
    """
    if spec.calendar == "gregorian":
        d = _utc_date(_col(created))
        return ((F.year(d) - F.lit(spec.base_year)) * 12 + F.month(d) - 1).cast("long")
    return idiv(_col(created) - F.lit(spec.origin), spec.month_s)


def cal_year(cal_month_col: str | Column, spec: CohortSpec) -> Column:
    """Year of a calendar month index. Julian: ``(t-origin) div year_s`` equals
    ``cal_month div 12`` because year_s = 12 * month_s; Gregorian: the calendar year."""
    if spec.calendar == "gregorian":
        return F.lit(spec.base_year) + F.floor(_col(cal_month_col) / F.lit(12)).cast("long")
    return F.lit(spec.base_year) + idiv(cal_month_col, 12)


def user_month(created: str | Column, first: str | Column, spec: CohortSpec) -> Column:
    """User-clock month index: months since the author's first post."""
    return idiv(_col(created) - _col(first), spec.month_s)


def cohort_year(first: str | Column, spec: CohortSpec) -> Column:
    """Cohort of an author from the epoch second of their first post."""
    if spec.calendar == "gregorian":
        return F.year(_utc_date(_col(first))).cast("long")
    if spec.calendar != "julian":
        raise ValueError(f"unknown calendar {spec.calendar!r}")
    return F.lit(spec.base_year).cast("long") + idiv(_col(first) - F.lit(spec.origin), spec.year_s)


def survival_years(time_active: str | Column, spec: CohortSpec) -> Column:
    """Survival bucket: whole years between first and last post (0 = under a year)."""
    return idiv(time_active, spec.year_s)


def calendar_x(cal_month_col: str | Column, spec: CohortSpec) -> Column:
    """Chart x of a calendar month: base_year + month/12, as double."""
    return F.lit(spec.base_year) + _col(cal_month_col).cast("double") / F.lit(12)


def user_x(user_month_col: str | Column) -> Column:
    """Chart x of a user month: years since the first post, as double."""
    return _col(user_month_col).cast("double") / F.lit(12)


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as double; NULL when den is 0 or NULL (instead of an ANSI error)."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))
