"""Distinct counts with a threshold: exact while a group has at most ``n`` values, a sketch above.

A group's state is a row that can be stored and merged: its values if there are at most ``n`` of
them (else NULL), and always an HLL sketch of them. Merging states to coarser groups reads the
states alone, never the rows again: a merged group is exact if all its parts are and their values
together are at most ``n``; otherwise its sketches are united. Which of the two counts is decided for
each group by itself. No group's values are ever collected beyond ``n``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12


def relative_error(lg_k: int = LG_K) -> float:
    """Relative standard deviation of a sketch united from others."""
    return 1.04 / math.sqrt(1 << lg_k)


def _with_members(groups: DataFrame, values: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Adds ``members``: the values of each group that has at most ``n`` (column ``_k`` counts them), else NULL."""
    small = groups.where(F.col("_k") <= n).select(*keys)
    same = [values[k].eqNullSafe(small[k]) for k in keys]
    few = values.join(small, same, "left_semi").groupBy(*keys).agg(F.collect_set("_v").alias("members"))
    few = few.withColumnsRenamed({k: f"_g{i}" for i, k in enumerate(keys)})
    found = groups.join(few, [groups[k].eqNullSafe(few[f"_g{i}"]) for i, k in enumerate(keys)], "left")
    # a group without any value has no row in ``values``
    members = F.when(F.col("_k") <= n, F.coalesce("members", F.array().cast("array<string>")))
    return found.select(*keys, members.alias("members"), "sketch")


def distinct_states(rows: DataFrame, keys: list[str], value: str, n: int, lg_k: int = LG_K, unique: bool = False) -> DataFrame:
    """keys, members, sketch of the distinct ``value`` (as text) per group; NULL values count in none, NULL keys are
    a group like others. ``unique``: ``rows`` has each (keys, value) once, so they need not be made distinct first."""
    values = rows.select(*keys, F.col(value).cast("string").alias("_v"))
    values = values if unique else values.distinct()
    groups = values.groupBy(*keys).agg(F.count("_v").alias("_k"), F.hll_sketch_agg("_v", lg_k).alias("sketch"))
    return _with_members(groups, values.where(F.col("_v").isNotNull()), keys, n)


def merged_states(states: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The states of the coarser groups ``keys``."""
    values = states.where(F.col("members").isNotNull()).select(*keys, F.explode("members").alias("_v")).distinct()
    sketches = states.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"), F.bool_and(F.col("members").isNotNull()).alias("_exact"))
    counts = values.groupBy(*keys).agg(F.count("*").alias("_n")).withColumnsRenamed({k: f"_g{i}" for i, k in enumerate(keys)})
    groups = sketches.join(counts, [sketches[k].eqNullSafe(counts[f"_g{i}"]) for i, k in enumerate(keys)], "left")
    known = F.when(F.col("_exact"), F.coalesce("_n", F.lit(0)))
    groups = groups.select(*keys, "sketch", F.coalesce(known, F.lit(n + 1)).alias("_k"))
    return _with_members(groups, values, keys, n)


def is_exact() -> Column:
    return F.col("members").isNotNull()


def distinct_count() -> Column:
    """The count of a state: of its values, or the sketch's estimate."""
    return F.when(is_exact(), F.size("members").cast("long")).otherwise(F.hll_sketch_estimate("sketch"))
