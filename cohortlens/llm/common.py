"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlens.sources.sinks import materialize

__all__ = ["crc32_of", "hot_join", "materialize", "n_words", "read", "rows_per_bucket", "runs", "ship", "utf8_bytes"]

# the ASCII white space that separates words: space and U+0009 to U+000D
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    """A driver table, only the columns that are used (so extra columns never clash)."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*[df[c] for c in cols]) if cols else df


def n_words(text: Column) -> Column:
    """Number of words of a text (NULL: 0), without building an array of them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def crc32_of(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 text; NULL counts as the empty text."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


# any fixed number: a key XOR this is another column to the planner
_REKEY = 0x2545F4914F6CDD1D


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join on a long ``key`` of which one value may hold a large share of ``left``.

    When ``right`` comes from an aggregation by the same key, the planner reuses that
    partitioning and adaptive execution can no longer split the hot partition. Joining on
    a bijection of the key makes both sides shuffle for this join alone, so a skewed
    partition of ``left`` is split and its few ``right`` rows are read by every piece.
    """
    l = left.withColumn("__k", F.col(key).bitwiseXOR(F.lit(_REKEY)))
    r = right.withColumn("__k", F.col(key).bitwiseXOR(F.lit(_REKEY))).drop(key)
    return l.join(r, "__k", how).drop("__k")


def rows_per_bucket(total: int, most: int = 100_000, buckets: int = 512) -> int:
    """Rows that one sorted bucket should hold: a 512th of the rows, 100,000 at most (whole texts may be among them)."""
    return max(1, min(most, -(-total // buckets)))


def runs(batches: Iterator[pd.DataFrame], *keys: str) -> Iterator[pd.DataFrame]:
    """The rows of each key, one key after the other, from batches sorted by ``keys``
    (``repartition(*keys).sortWithinPartitions(*keys)``): like a grouped map, without the
    cost of an Arrow stream for each group. Keys must not be NULL."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        new = np.zeros(len(pdf) - 1, bool)
        for key in keys:
            k = pdf[key].to_numpy()
            new |= k[1:] != k[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(pdf)]
        for i, j in zip(cuts, cuts[1:]):
            if held and any(held[-1][key].iloc[-1] != pdf[key].iloc[i] for key in keys):
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            held.append(pdf.iloc[i:j])
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package's source to the executors (once per application), so Python
    workers import it wherever it is installed and keep module state between tasks."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="cohortlens-ship-")
    shutil.copytree(package, os.path.join(folder, "src", "cohortlens"), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "cohortlens_src"), "zip", os.path.join(folder, "src")))
    _SHIPPED.add(sc.applicationId)
