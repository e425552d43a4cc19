from cohortlens.functions.cells import json_array_cell, json_cell
from cohortlens.functions.clocks import (
    cal_month,
    cal_year,
    calendar_x,
    cohort_year,
    epoch_seconds,
    idiv,
    ratio,
    survival_years,
    user_month,
    user_x,
)
from cohortlens.functions.names import drop_reason, is_bot_name, keep_author

__all__ = [
    "cal_month",
    "cal_year",
    "calendar_x",
    "cohort_year",
    "drop_reason",
    "epoch_seconds",
    "idiv",
    "is_bot_name",
    "json_array_cell",
    "json_cell",
    "keep_author",
    "ratio",
    "survival_years",
    "user_month",
    "user_x",
]
