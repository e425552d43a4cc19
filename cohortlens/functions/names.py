"""Author-name rules used to drop deleted accounts and bot-like names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cleaning rules of the analysed data set.
DELETED_AUTHOR = "[deleted]"
BOT_SUFFIXES = ("_bot", "Bot")  # compared case-sensitively
BOT_WORDS = ("transcriber", "automoderator")  # compared case-insensitively


def is_bot_name(author: str | Column) -> Column:
    """True for names ending in a bot suffix or containing a bot word."""
    a = F.col(author) if isinstance(author, str) else author
    cond = F.lit(False)
    for suffix in BOT_SUFFIXES:
        cond = cond | a.endswith(suffix)
    low = F.lower(a)
    for word in BOT_WORDS:
        cond = cond | low.contains(word)
    return cond


def keep_author(author: str | Column) -> Column:
    """Row filter of the cleaning step: not deleted and not bot-like.

    NULL authors yield NULL (three-valued logic) and are therefore dropped by ``where``.
    """
    a = F.col(author) if isinstance(author, str) else author
    return (a != F.lit(DELETED_AUTHOR)) & ~is_bot_name(a)


def drop_reason(author: str | Column, created: str | Column) -> Column:
    """First cleaning rule a raw row fails, or NULL when it is kept."""
    a = F.col(author) if isinstance(author, str) else author
    c = F.col(created) if isinstance(created, str) else created
    return (
        F.when(c.isNull(), "null_time")
        .when(a.isNull() | (a == F.lit(DELETED_AUTHOR)), "deleted_author")
        .when(a.endswith(BOT_SUFFIXES[0]) | a.endswith(BOT_SUFFIXES[1]), "bot_suffix")
        .when(F.lower(a).contains(BOT_WORDS[0]) | F.lower(a).contains(BOT_WORDS[1]), "bot_word")
    )
