"""Results saved in pages: any page is read by itself, so a fetch can begin or go on anywhere.

Rows are sorted globally and numbered; only one count per range is ordered as a whole. An index keeps, for each page, its
number of rows, its first key and the files it lies in, so that reading a page opens those files alone, and its rows are
found there by the statistics of the page column.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.sources.sinks import materialize

PAGE, ROW = "_page", "_row"


def numbered_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """All rows with their position in ``order`` (from 0); ties go by all columns, and equal rows are interchangeable."""
    every = [F.col(c).asc_nulls_first() for c in order] + [F.xxhash64(*df.columns)]
    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "page-ranges")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*every)) - 1
    return ranged.join(counts.select("_part", before.alias("_before")), "_part").withColumn(ROW, F.col("_before") + inside).drop("_part", "_before")


def save_pages(df: DataFrame, path: str, order: list[str], page_size: int = 10_000, rows_per_file: int = 1_000_000) -> None:
    """Writes the rows under ``path``/rows, at most ``rows_per_file`` to a file, and the index under ``path``/index. An empty result has no pages."""
    if page_size < 1 or not order:
        raise ValueError("pages need a positive size and an order")
    rows = numbered_rows(df, order).withColumn(PAGE, F.floor(F.col(ROW) / page_size).cast("long"))
    rows.repartitionByRange(ROW).sortWithinPartitions(ROW).write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
    saved = df.sparkSession.read.parquet(f"{path}/rows").withColumn("_file", F.input_file_name())
    key = F.struct(*order).alias("first_key")
    index = saved.select(PAGE, ROW, "_file", key).groupBy(PAGE).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min_by("first_key", ROW).alias("first_key"), F.collect_set("_file").alias("files"))
    index.repartitionByRange(PAGE).sortWithinPartitions(PAGE).write.mode("errorifexists").parquet(f"{path}/index")


def page_index(spark: SparkSession, path: str) -> DataFrame:
    """_page, n_rows, first_key, files."""
    return spark.read.parquet(f"{path}/index")


def fetch_page(spark: SparkSession, path: str, page: int) -> DataFrame:
    """The rows of one page, in order (none beyond the last page). Only the page's files are read."""
    found = page_index(spark, path).where(F.col(PAGE) == page).select("files").first()
    files = sorted(found["files"]) if found else []
    rows = spark.read.parquet(*files) if files else spark.read.parquet(f"{path}/rows").where("false")
    return rows.where(F.col(PAGE) == page).orderBy(ROW).drop(PAGE, ROW)


def fetch_from(spark: SparkSession, path: str, page: int = 0) -> Iterator[list]:
    """The rows of one page after the other, from ``page`` on: where an earlier fetch stopped."""
    while rows := fetch_page(spark, path, page).collect():  # page_size rows at most
        yield rows
        page += 1
