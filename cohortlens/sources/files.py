"""File sources for raw post logs: yearly shards, newline-delimited JSON dumps, CSV.

All readers take an explicit schema (no inference pass over the data) and return lazy
DataFrames, so filters and projections of the caller reach the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.clocks import cal_month, cal_year
from cohortlens.operators.clean import apply_window
from cohortlens.sources.sinks import materialize
from cohortlens.spec import CohortSpec

RAW_COMMENT_SCHEMA = T.StructType(
    [
        T.StructField("body", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("created_utc", T.LongType()),
        T.StructField("subreddit", T.StringType()),
    ]
)

RAW_SUBMISSION_SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("selftext", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("created_utc", T.LongType()),
        T.StructField("subreddit", T.StringType()),
    ]
)

SCHEMAS = {"comment": RAW_COMMENT_SCHEMA, "submission": RAW_SUBMISSION_SCHEMA}

SHARD_COLUMN = "year"
CORRUPT_COLUMN = "_corrupt_record"


def shard_year(created: str, spec: CohortSpec):
    """Shard key of a raw row: the year of its creation time on the spec's calendar
    (NULL stays NULL)."""
    return cal_year(cal_month(created, spec), spec).cast("long")


def write_shards(df: DataFrame, path: str, spec: CohortSpec, mode: str = "errorifexists") -> None:
    """Store a raw log as one dataset partitioned by year (the yearly shards), each file in order of time, so that
    its row groups cover narrow spans."""
    (
        df.withColumn(SHARD_COLUMN, shard_year("created_utc", spec))
        .sortWithinPartitions(SHARD_COLUMN, "created_utc")
        .write.mode(mode)
        .partitionBy(SHARD_COLUMN)
        .parquet(path)
    )


def window_years(spec: CohortSpec) -> tuple[int, int] | None:
    """The first and the last shard that the spec's observation window [start, end) reaches; None without a window."""
    if spec.window is None:
        return None
    ends = spec.window[0], max(spec.window[0], spec.window[1] - 1)
    if spec.calendar == "gregorian":
        low, high = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (1, 9999))
        first, last = (datetime.fromtimestamp(min(max(t, low), high), timezone.utc).year for t in ends)
    else:  # as the shard key does, months before the origin are cut toward zero
        first, last = (spec.base_year + int(int((t - spec.origin) / spec.month_s) / 12) for t in ends)
    return first, last


def read_shards(spark: SparkSession, path: str, years: Iterable[int] | None = None, spec: CohortSpec | None = None) -> DataFrame:
    """Union of the selected yearly shards, or of those that the window of ``spec`` reaches.

    The year filter is on the partition column, so Spark lists and reads only the
    selected directories (partition pruning) instead of opening every shard. With a window, the rows are
    also cut to it, a filter on the time that skips row groups inside the first and last shard.
    """
    df = spark.read.parquet(path)
    if years is not None:
        df = df.where(F.col(SHARD_COLUMN).isin([int(y) for y in years]))
    elif spec is not None and spec.window is not None:
        df = df.where(F.col(SHARD_COLUMN).between(*window_years(spec)))
    df = df.drop(SHARD_COLUMN)
    return df if spec is None else apply_window(df, spec)


def _within_cap(parsed: DataFrame, max_bad_records: int, name: str) -> DataFrame:
    """The good rows of a fully parsed input (with the corrupt-record column), if no more than
    ``max_bad_records`` are bad. The parsed rows are saved first: what is bad is then decided
    once, over all columns, whatever columns the caller reads later."""
    saved = materialize(parsed, name)
    bad = saved.where(F.col(CORRUPT_COLUMN).isNotNull()).count()
    if bad > max_bad_records:
        raise ValueError(f"{bad} malformed records exceed the limit of {max_bad_records}")
    return saved.where(F.col(CORRUPT_COLUMN).isNull()).drop(CORRUPT_COLUMN)


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(CORRUPT_COLUMN, T.StringType())])


def read_json(
    spark: SparkSession,
    path: str | list[str],
    kind: str = "comment",
    schema: T.StructType | None = None,
    mode: str = "PERMISSIVE",
    max_bad_records: int | None = None,
    ignore_unknown_values: bool = True,
) -> DataFrame:
    """Newline-delimited JSON dumps (wildcards and compressed files accepted).

    With ``max_bad_records`` a line is bad if it is no JSON object or a value of any column
    has another type (or, without ``ignore_unknown_values``, if it has fields that the
    schema lacks); bad lines are left out, more of them than the cap raise an error. Without
    a cap nothing is checked: what cannot be read is NULL.
    """
    schema = schema or SCHEMAS[kind]
    if max_bad_records is None:
        return spark.read.option("mode", mode).schema(schema).json(path)
    lines = spark.read.text(path).where(F.trim("value") != "")
    record = F.from_json("value", _with_corrupt(schema), {"columnNameOfCorruptRecord": CORRUPT_COLUMN, "mode": "PERMISSIVE"})
    rows = lines.select("value", record.alias("r"))
    bad = F.col(f"r.{CORRUPT_COLUMN}")
    if not ignore_unknown_values:
        known = F.array(*[F.lit(f.name) for f in schema.fields])
        unknown = F.size(F.array_except(F.json_object_keys("value"), known)) > 0
        bad = F.coalesce(bad, F.when(unknown, F.col("value")))
    return _within_cap(rows.select("r.*", bad.alias("_bad")).drop(CORRUPT_COLUMN).withColumnRenamed("_bad", CORRUPT_COLUMN),
                       max_bad_records, "json-parsed")


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    kind: str = "comment",
    schema: T.StructType | None = None,
    sep: str = ",",
    quote: str = '"',
    encoding: str = "UTF-8",
    header: bool = True,
    multiline: bool = False,
    mode: str = "PERMISSIVE",
    max_bad_records: int | None = None,
    null_value: str | None = None,
    skip_rows: int = 0,
    allow_jagged_rows: bool = False,
    ignore_unknown_values: bool = False,
) -> DataFrame:
    """CSV exports: delimiter, quote, encoding, header row, quoted newlines, bad-record cap.

    Files are split over tasks; ``multiline`` (newlines inside quotes) makes each file one
    task and must be asked for. ``skip_rows`` leaves out that many rows at the start of each
    file, instead of one with ``header``. Compression is picked from the file extension.
    ``null_value`` is the marker of NULL fields (e.g. ``\\N``); without it an empty field
    reads as NULL, so empty strings cannot be told apart from NULLs.

    With ``max_bad_records`` a row is bad if a value of any column has another type, if it
    has too few fields (unless ``allow_jagged_rows``: the rest are NULL) or too many (unless
    ``ignore_unknown_values``: they are left out). Bad rows are left out, more of them than
    the cap raise an error. Without a cap nothing is checked.
    """
    schema = schema or SCHEMAS[kind]
    options = {"sep": sep, "quote": quote, "escape": quote}
    if null_value is not None:
        options["nullValue"] = null_value
    reader = spark.read.options(**options, encoding=encoding, header=header and not skip_rows, multiLine=multiline, mode=mode)
    if max_bad_records is None and not skip_rows:
        return reader.schema(schema).csv(path)
    full = _with_corrupt(schema)
    df = reader.option("columnNameOfCorruptRecord", CORRUPT_COLUMN).schema(full).csv(path)
    if skip_rows:
        # rows of a file's first block are numbered in file order
        at = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id()}
        df = materialize(df.withColumns(at), "csv-rows")
        first = df.where("_block = 0").groupBy("_file").agg(F.min("_row").alias("_first"))  # one row a file
        df = df.join(first, "_file", "left").where((F.col("_block") > 0) | (F.col("_row") >= F.col("_first") + skip_rows)).drop(
            "_file", "_block", "_row", "_first")
    if allow_jagged_rows or ignore_unknown_values:
        df = _repaired(df, schema, full, sep, quote, options, allow_jagged_rows, ignore_unknown_values)
    if max_bad_records is None:
        return df.drop(CORRUPT_COLUMN)
    return _within_cap(df, max_bad_records, "csv-parsed")


def _repaired(df: DataFrame, schema: T.StructType, full: T.StructType, sep: str, quote: str, options: dict, short: bool, long: bool) -> DataFrame:
    """Reads rows with too few or too many fields again, filled up or cut to the schema."""
    n, raw = len(schema.fields), F.col(CORRUPT_COLUMN)
    s, q = re.escape(sep), re.escape(quote)
    quoted = f"{q}(?:[^{q}]|{q}{q})*{q}"
    fields = F.regexp_count(F.regexp_replace(raw, quoted, ""), F.lit(s)) + 1
    field = f"(?:{quoted}|[^{s}{q}]*)"
    fixed = F.lit(None).cast("string")
    if short:
        fixed = F.when(fields < n, F.concat(raw, F.repeat(F.lit(sep), n - fields))).otherwise(fixed)
    if long:
        fixed = F.when(fields > n, F.regexp_extract(raw, f"^((?:{field}{s}){{{n - 1}}}{field})", 1)).otherwise(fixed)
    again = F.from_csv(fixed, full.simpleString()[7:-1].replace(":", " "), {**options, "columnNameOfCorruptRecord": CORRUPT_COLUMN})
    df = df.withColumn("_again", F.when(raw.isNotNull() & fixed.isNotNull(), again))
    good = F.col("_again").isNotNull() & F.col(f"_again.{CORRUPT_COLUMN}").isNull()
    return df.select(*[F.when(good, F.col(f"_again.{f.name}")).otherwise(F.col(f.name)).alias(f.name) for f in full.fields])
