"""Exact running totals and positions over a table too large for one sorted task.

Rows are dealt to small ordered buckets; only one sum per bucket is ordered globally, and
each bucket's own rows are ordered inside its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def spread(h31: Column, buckets: Column) -> Column:
    """Bucket 0 .. buckets-1 of a uniform 31-bit number; larger numbers never get smaller buckets."""
    return F.shiftright(h31 * buckets, 31)


def running_before(df: DataFrame, group: str | None, bucket: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds one column per entry of ``sums``: the value's total over all earlier rows of the
    same ``group`` (None: of the table), earlier by (``bucket``, ``order``).

    ``group`` and ``bucket`` must not be NULL. The bucket totals of one group are summed in
    one task, so keep them few (see ``common.rows_per_bucket``); rows never are.
    """
    keys = [k for k in (group, bucket) if k]
    val, base = (lambda c: f"__v_{c}"), (lambda c: f"__b_{c}")
    df = df.withColumns({val(c): e for c, e in sums.items()})
    totals = df.groupBy(*keys).agg(*[F.sum(val(c)).alias(base(c)) for c in sums])
    w = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, *[F.coalesce(F.sum(base(c)).over(w), F.lit(0)).alias(base(c)) for c in sums])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(totals, keys)
    return out.withColumns({c: F.col(base(c)) + F.coalesce(F.sum(val(c)).over(inside), F.lit(0)) for c in sums}).drop(
        *[f(c) for c in sums for f in (val, base)])
