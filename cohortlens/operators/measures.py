"""The three per-group measures, in cell form and in direct (per-post) form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.functions.clocks import ratio


@dataclass(frozen=True)
class Measure:
    name: str
    # aggregate over (author, month) cells
    from_cells: Callable[[], Column]
    # aggregate over enriched posts (per-post form with COUNT DISTINCT)
    direct: Callable[[], Column]
    # comment-only measures look only at comments / cells that contain comments
    comments_only: bool = False

    def cell_filter(self) -> Column | None:
        return F.col("n_comments") > 0 if self.comments_only else None

    def post_filter(self) -> Column | None:
        return F.col("comment") == 1 if self.comments_only else None


POSTS_PER_USER = Measure(
    "posts_per_user",
    from_cells=lambda: ratio(F.sum("n_posts"), F.count(F.lit(1))),
    direct=lambda: ratio(F.count(F.lit(1)), F.countDistinct("author")),
)

# sum of sizes over the number of comments: NULL sizes count in the denominator
COMMENT_LENGTH = Measure(
    "comment_length",
    from_cells=lambda: ratio(F.sum("sum_comment_size"), F.sum("n_comments")),
    direct=lambda: ratio(F.sum("body_size"), F.count(F.lit(1))),
    comments_only=True,
)

# NULL when the group has no submission
COMMENTS_PER_SUBMISSION = Measure(
    "comments_per_submission",
    from_cells=lambda: ratio(F.sum("n_comments"), F.sum("n_submissions")),
    direct=lambda: ratio(F.sum("comment"), F.sum("submission")),
)

MEASURES = {m.name: m for m in (POSTS_PER_USER, COMMENT_LENGTH, COMMENTS_PER_SUBMISSION)}
