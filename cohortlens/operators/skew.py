"""Skew-aware N:1 equi-join of a large fact frame with a dimension derived from it.

Some keys (one author, one community) can carry a large share of all rows. A plain
shuffle join sends all rows of such a key to one task. Here the dimension already
knows how many fact rows each key has (``weight``), so:

1. hot keys are all those with ``weight > rows_per_task``, whatever the total;
2. each hot key gets ``ceil(weight / rows_per_task)`` salts; fact rows of a hot key take
   the salts in turn by their position in the scan (so equal rows are spread too), cold
   keys use salt 0;
3. the dimension rows of hot keys are replicated once per salt (fewer than
   ``2 * total / rows_per_task`` extra rows) and the two sides are shuffle-joined on
   (key, salt), so no task receives more than about ``rows_per_task`` rows of one key.

The list of hot keys is broadcast up to ``max_hot`` keys. A longer one is joined by
shuffle, replicated ``LOOKUPS`` times and read by that many parts of each key, so looking
up the salts is spread as well.

No row is dropped or sampled; the result equals the plain inner join. How many hot keys
there are is counted over the dimension when the plan is built. Rows are numbered by
``numbered`` on a scan with narrow steps on top (a saved table), where a retried task
numbers its rows the same way. Behind a shuffle it would not: rows arrive in another order
after a lost executor, and a recomputed map task could salt them differently. So a second
join takes the numbers of the first scan along (``row``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = "_salt"
N_SALTS = "_n_salts"
LOOK = "_look"
ROW = "_row"
LOOKUPS = 64


def numbered(scan: DataFrame) -> DataFrame:
    """A saved table with a number for each row (column ``_row``), the same whenever a task is run again."""
    return scan.withColumn(ROW, F.monotonically_increasing_id())


def hot_keys(dim: DataFrame, key: str, weight: str, rows_per_task: int) -> DataFrame:
    """(key, _n_salts) for all keys heavier than ``rows_per_task``."""
    return dim.where(F.col(weight) > rows_per_task).select(
        key, F.ceil(F.col(weight) / F.lit(rows_per_task)).cast("int").alias(N_SALTS)
    )


def salted_join(
    big: DataFrame,
    dim: DataFrame,
    key: str,
    weight: str,
    rows_per_task: int = 4_000_000,
    max_hot: int = 10_000,
    row: str | None = None,
) -> DataFrame:
    """Inner join ``big`` with ``dim`` on ``key`` (N:1), splitting heavy keys.

    ``row``: the column of ``big`` that numbers its rows (kept in the result); None: ``big``
    is a scan with narrow steps and is numbered here.

    ``dim`` must have one row per key and a column ``weight`` = rows of ``big`` per key
    (an upper bound is enough).
    """
    hot = hot_keys(dim, key, weight, rows_per_task)
    rows = big if row else numbered(big)
    number = F.col(row or ROW)
    if hot.count() <= max_hot:
        looked_up = rows.join(F.broadcast(hot), key, "left")
        known = dim.join(F.broadcast(hot), key, "left")
    else:
        copies = hot.withColumn(LOOK, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LOOKUPS - 1).cast("long"))))
        looked_up = rows.withColumn(LOOK, F.pmod(number, F.lit(LOOKUPS).cast("long"))).join(copies, [key, LOOK], "left")
        known = dim.join(hot, key, "left")
    n_salts = F.coalesce(F.col(N_SALTS), F.lit(1))
    big_s = looked_up.select(*big.columns, F.pmod(number, n_salts.cast("long")).cast("int").alias(SALT))
    dim_s = known.select(*dim.columns, F.explode(F.sequence(F.lit(0), n_salts - 1)).alias(SALT))
    return big_s.join(dim_s, [key, SALT]).drop(SALT)
