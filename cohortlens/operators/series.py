"""Result series ``(x double, series string, y double)`` and per-series post-processing.

Windows here always run on aggregated series (one row per series and month), which
are bounded by the number of months in the observation window, never on posts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES_COLUMNS = ("x", "series", "y")


def as_series(df: DataFrame, x: Column, series: Column, y: Column, *extra: str | Column) -> DataFrame:
    """Project to the typed series contract (plus optional key columns first)."""
    return df.select(
        *extra,
        x.cast("double").alias("x"),
        series.cast("string").alias("series"),
        y.cast("double").alias("y"),
    )


def _by(df: DataFrame) -> list[str]:
    return [c for c in ("cohort", "series") if c in df.columns]


def cumulative(df: DataFrame, share: bool = False) -> DataFrame:
    """Running sum of y in x order within each series; ``share`` divides by the
    series total (a cumulative distribution ending at 1)."""
    w = Window.partitionBy(*_by(df)).orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    y = F.sum("y").over(w)
    if share:
        y = y / F.sum("y").over(Window.partitionBy(*_by(df)))
    return df.withColumn("y", y.cast("double"))


def normalize(df: DataFrame, how: str) -> DataFrame:
    """Per-series normalisation: 'sum' -> y/sum(y); 'y' -> y/max(y); 'x' -> x/max(x).
    'x' combines with either of the others ('x,sum', 'xy')."""
    w = Window.partitionBy(*_by(df))
    out = df
    if "x" in how.replace("max", ""):
        out = out.withColumn("x", F.try_divide(F.col("x"), F.max("x").over(w)))
    if "sum" in how:
        out = out.withColumn("y", F.try_divide(F.col("y"), F.sum("y").over(w)))
    elif "y" in how or "max" in how:
        out = out.withColumn("y", F.try_divide(F.col("y"), F.max("y").over(w)))
    return out


def series_order(series: str | Column = "series") -> list[Column]:
    """Sort keys of series labels: numeric labels (cohort years, survival buckets) by
    value, so bucket 10 follows 9, then the other labels ('Overall', ...) by text."""
    s = F.col(series) if isinstance(series, str) else series
    return [s.try_cast("long").asc_nulls_last(), s.asc()]


def ordered(df: DataFrame) -> DataFrame:
    """Final order: by (cohort,) series, then x."""
    keys = [F.col("cohort")] if "cohort" in df.columns else []
    return df.orderBy(*keys, *series_order(), "x")
