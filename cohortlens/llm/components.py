"""Connected components of a link table that never leaves the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import hot_join, materialize


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links ``a``-``b``."""
    root = np.arange(n)
    while len(a):
        lo = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], lo)
        np.minimum.at(new, root[b], lo)
        while not np.array_equal(new, nxt := new[new]):
            new = nxt
        root = new[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _large_star(e: DataFrame) -> DataFrame:
    """Each node sends its smallest neighbour (or itself) to its larger neighbours."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (hot_join(both, low, "u").where("v > u")
            .select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = hot_join(down, low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (long columns ``a``, ``b``), where root is
    the smallest node reachable.

    Large-star and small-star rounds until every link points at its root; the number of
    rounds grows with the logarithm of the component size. Each round is written to the
    shared folder, so lineage stays short and a lost executor costs one round at most.
    Links with NULL ends and self-links are ignored; no links give an empty result. A
    node of many links is aggregated map-side and its join is split by AQE.
    """
    e = materialize(links.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
                    .distinct(), "links")
    if not e.isEmpty():
        while True:
            e = materialize(_small_star(_large_star(e)), "links")
            # all stars: no root is itself linked to a smaller node, one root for each node
            roots = e.select(F.col("b").alias("a")).distinct()
            if e.join(roots, "a", "left_semi").isEmpty() and e.groupBy("a").count().where("count > 1").isEmpty():
                break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
