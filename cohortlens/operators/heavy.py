"""The keys with the most rows, without sending every key over the network.

1. One aggregation keeps a bounded sketch of frequent keys in each task and merges the sketches: what
   travels is at most ``tracked`` keys a task, however many keys there are.
2. The keys of the merged sketch (at most ``tracked``, broadcast) are counted exactly in a second scan.
3. A key the sketch does not report has at most ``7 N / tracked`` of the N rows: the sketch's error is at most
   ``3.5 N / tracked``, and it leaves out keys of up to twice that. If the k-th exact count is above this bound, the
   top k is proven. If not (counts too even for a sketch), all keys are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACKED = 10_000


def candidates(rows: DataFrame, key: str, tracked: int = TRACKED) -> DataFrame:
    """At most ``tracked`` keys, among them every key with more than ``7 N / tracked`` of the N rows."""
    sketch = rows.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {tracked}, {tracked})").alias("top"))
    return sketch.select(F.explode("top").alias("t")).select(F.col("t.item").alias(key))


def count_by(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def is_proven(least: int | None, found: int, k: int, total: int, tracked: int) -> bool:
    """Whether ``found`` counted candidates, the k-th with ``least`` rows, hold the top k of ``total`` rows."""
    return found >= k and least is not None and least * tracked > 7 * total


def top_keys(rows: DataFrame, key: str, k: int, tracked: int = TRACKED) -> tuple[DataFrame, int, bool]:
    """(key, n) of the ``k`` keys with the most rows, ties by key; the number of all rows, NULL keys too; and
    whether the sketch's candidates sufficed. ``rows`` is scanned twice, three times without the proof."""
    total = rows.count()
    near = candidates(rows, key, tracked)
    counted = rows.join(F.broadcast(near), key, "left_semi")
    best = count_by(counted, key).orderBy(F.desc("n"), F.asc(key)).limit(k)
    found = best.collect()  # k rows: the report itself
    if is_proven(found[-1]["n"] if found else None, len(found), k, total, tracked):
        return rows.sparkSession.createDataFrame(found, best.schema), total, True
    return count_by(rows, key).orderBy(F.desc("n"), F.asc(key)).limit(k), total, False
