"""Time-aware cohort analytics of community post logs on Spark."""

from cohortlens.operators.series import cumulative, normalize, ordered
from cohortlens.plans.community import Community
from cohortlens.spec import FIXTURE, REDDIT, CohortSpec

__all__ = ["Community", "CohortSpec", "FIXTURE", "REDDIT", "cumulative", "normalize", "ordered"]
