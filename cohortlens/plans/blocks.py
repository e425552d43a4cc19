"""Registered building blocks, sources and sinks (each returns the rows it produces)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.cells import json_array_cell, json_cell
from cohortlens.operators.clean import clean_comments, clean_posts, clean_submissions, union_raw, window_filter
from cohortlens.operators.dims import SUBREDDIT_COLUMNS, USER_COLUMNS
from cohortlens.operators.enrich import enrich_posts
from cohortlens.plans.analyses import q02_active_monthly, q05_posts_per_user_cohort_time
from cohortlens.plans.community import Community
from cohortlens.sources.files import read_csv, read_json, read_shards, write_shards
from cohortlens.sources.sinks import materialize, save, scratch_path
from cohortlens.streaming.ingest import ingest


def clean_posts_block(c: Community) -> DataFrame:
    """Cleaned comments and submissions (the posts table)."""
    return c.posts


def posts_union_block(c: Community) -> DataFrame:
    """Both raw streams in the post layout, UNION ALL, before cleaning."""
    return union_raw(c.raw_comments, c.raw_submissions)


def users_dim_block(c: Community) -> DataFrame:
    return c.users.select(*USER_COLUMNS)


def subreddits_dim_block(c: Community) -> DataFrame:
    return c.subreddits.select(*SUBREDDIT_COLUMNS)


def enrich_posts_block(c: Community) -> DataFrame:
    return c.meta()


def calendar_cells_block(c: Community) -> DataFrame:
    """(author, calendar month) cells with cohort, survival and the four cell measures."""
    return c.calendar_cells


def user_cells_block(c: Community) -> DataFrame:
    """(author, user month) cells with cohort, survival and the four cell measures."""
    return c.user_cells


def community_cells_block(c: Community) -> DataFrame:
    """(community, calendar month) cells: posts a community received in the month."""
    return c.community_cells


def window_filter_block(c: Community) -> DataFrame:
    """Posts from the start of the first selected cohort year to the start of end_year."""
    s = c.spec
    return window_filter(c.posts, s.year_start(s.first_cohort), s.year_start(s.end_year))


def shard_years(c: Community) -> list[int]:
    return list(range(c.spec.base_year, c.spec.end_year + 1))


def scan_union_shards(c: Community) -> DataFrame:
    """Store both raw logs as yearly shards, then read back the selected years only
    (partition pruning) and clean them into posts."""
    spark = c.raw_comments.sparkSession
    cpath, spath = scratch_path(spark, "comment-shards"), scratch_path(spark, "submission-shards")
    write_shards(c.raw_comments, cpath, c.spec)
    write_shards(c.raw_submissions, spath, c.spec)
    years = shard_years(c)
    return clean_posts(read_shards(spark, cpath, years), read_shards(spark, spath, years))


def json_ingest(c: Community) -> DataFrame:
    """Dump both raw logs as newline-delimited JSON, load them with the fixed raw schemas
    (no inference pass) and clean them into posts."""
    spark = c.raw_comments.sparkSession
    paths = scratch_path(spark, "comments-json"), scratch_path(spark, "submissions-json")
    for raw, path in zip((c.raw_comments, c.raw_submissions), paths):
        raw.write.mode("errorifexists").json(path, compression="gzip")
    return clean_posts(read_json(spark, f"{paths[0]}/*.json.gz", "comment"), read_json(spark, f"{paths[1]}/*.json.gz", "submission"))


NULL_MARK = "\\N"


def csv_ingest(c: Community) -> DataFrame:
    """Export both raw logs as CSV (header row, NULLs written as the marker \\N so that empty
    texts stay empty strings), load them with the fixed raw schemas and clean them."""
    spark = c.raw_submissions.sparkSession
    paths = scratch_path(spark, "comments-csv"), scratch_path(spark, "submissions-csv")
    for raw, path in zip((c.raw_comments, c.raw_submissions), paths):
        raw.write.mode("errorifexists").option("header", True).option("nullValue", NULL_MARK).csv(path, compression="gzip")
    return clean_posts(read_csv(spark, f"{paths[0]}/*.csv.gz", "comment", null_value=NULL_MARK),
                       read_csv(spark, f"{paths[1]}/*.csv.gz", "submission", null_value=NULL_MARK))


def json_cells(c: Community) -> DataFrame:
    """Submissions whose author and community arrive as one JSON object and whose texts as a
    JSON array, parsed back into columns."""
    packed = c.raw_submissions.select(
        "created_utc",
        F.to_json(F.struct("author", "subreddit")).alias("who"),
        F.to_json(F.array("title", "selftext")).alias("texts"),
    )
    read = packed.select("created_utc", json_cell("who", "author string, subreddit string").alias("w"),
                         json_array_cell("texts", "string").alias("t"))
    return read.select("created_utc", F.col("w.author").alias("author"), F.col("w.subreddit").alias("subreddit"),
                       F.col("t")[0].alias("title"), F.col("t")[1].alias("selftext"))


ANY_NUMBER = 1 << 62  # of bad records


def json_bad_records(c: Community) -> DataFrame:
    """Comments as JSON lines, some with a time that is no number and some cut off; loaded
    with a bad-record cap, cleaned."""
    spark = c.raw_comments.sparkSession
    path = scratch_path(spark, "comments-bad-json")
    line, t = F.to_json(F.struct("body", "author", "created_utc", "subreddit")), F.col("created_utc")
    line = F.when(t % 7 == 0, F.regexp_replace(line, '"created_utc":[0-9]+', '"created_utc":"soon"')).when(
        t % 11 == 0, F.expr("substring(line, 1, 20)")).otherwise(line)
    c.raw_comments.withColumn("line", F.to_json(F.struct("body", "author", "created_utc", "subreddit"))).select(
        line.alias("value")).write.mode("errorifexists").text(path, compression="gzip")
    return clean_comments(read_json(spark, path, "comment", max_bad_records=ANY_NUMBER))


def csv_bad_records(c: Community) -> DataFrame:
    """Submissions as CSV lines, some with a time that is no number, some with a field too
    few and some with one too many; loaded with a bad-record cap, cleaned. Short rows are
    bad here, long ones are cut."""
    spark = c.raw_submissions.sparkSession
    path = scratch_path(spark, "submissions-bad-csv")
    options, t = {"nullValue": NULL_MARK}, F.col("created_utc")
    cols = ["title", "selftext", "author", "created_utc", "subreddit"]
    bad_time = [F.lit("soon").alias(x) if x == "created_utc" else F.col(x) for x in cols]
    line = F.when(t % 7 == 0, F.to_csv(F.struct(*bad_time), options)).when(t % 11 == 0, F.to_csv(F.struct(*cols[:4]), options)).when(
        t % 13 == 0, F.to_csv(F.struct(*cols, F.lit("more").alias("x")), options)).otherwise(F.to_csv(F.struct(*cols), options))
    c.raw_submissions.select(line.alias("value")).write.mode("errorifexists").text(path, compression="gzip")
    return clean_submissions(read_csv(spark, path, "submission", header=False, null_value=NULL_MARK,
                                      max_bad_records=ANY_NUMBER, ignore_unknown_values=True))


def write_dispositions(c: Community) -> DataFrame:
    """The users table saved anew, appended to, truncated and appended to again."""
    spark, users = c.users.sparkSession, users_dim_block(c)
    path = scratch_path(spark, "users-dispositions")
    for disposition in ("empty", "append", "truncate", "append"):
        save(users, path, disposition)
    return spark.read.schema(users.schema).parquet(path)


def enrich_posts_salted(c: Community) -> DataFrame:
    """The enriched posts with every key of more than 50 posts split, and more such keys
    than are broadcast."""
    return enrich_posts(c.posts, c.users, c.subreddits, c.spec, {"rows_per_task": 50, "max_hot": 10})


WINDOW = (820476000, 915145200)  # 1996-01-01 06:00 to 1998-12-31 23:00


def windowed(c: Community) -> Community:
    """The same log seen through an observation window."""
    return Community.from_posts(c.posts, c.spec.with_window(*WINDOW), materialize=True)


def q02_active_monthly_window(c: Community) -> DataFrame:
    return q02_active_monthly(windowed(c))


def q05_posts_per_user_cohort_time_window(c: Community) -> DataFrame:
    return q05_posts_per_user_cohort_time(windowed(c))


def materialize_roundtrip(c: Community) -> DataFrame:
    """Save the users table (fails if the target exists) and read it back."""
    return materialize(users_dim_block(c), "users-saved", disposition="empty")


def stream_ingest(c: Community, files_per_trigger: int = 2) -> DataFrame:
    """Dump raw submissions as JSON files, ingest them with a streaming query in several
    micro-batches (available-now trigger) and read the resulting table."""
    spark = c.raw_submissions.sparkSession
    src = scratch_path(spark, "submissions-dump")
    sink = scratch_path(spark, "submissions-stream")
    c.raw_submissions.write.mode("errorifexists").json(src, compression="gzip")
    q = ingest(spark, src, "submission", sink, scratch_path(spark, "stream-checkpoint"), files_per_trigger)
    q.awaitTermination()
    return spark.read.parquet(sink)


BLOCKS = {
    "clean_posts": clean_posts_block,
    "posts_union": posts_union_block,
    "users_dim": users_dim_block,
    "subreddits_dim": subreddits_dim_block,
    "enrich_posts": enrich_posts_block,
    "calendar_cells": calendar_cells_block,
    "user_cells": user_cells_block,
    "community_cells": community_cells_block,
    "window_filter": window_filter_block,
    "scan_union_shards": scan_union_shards,
    "json_ingest": json_ingest,
    "csv_ingest": csv_ingest,
    "json_cells": json_cells,
    "json_bad_records": json_bad_records,
    "csv_bad_records": csv_bad_records,
    "materialize_roundtrip": materialize_roundtrip,
    "write_dispositions": write_dispositions,
    "enrich_posts_salted": enrich_posts_salted,
    "q02_active_monthly_window": q02_active_monthly_window,
    "q05_posts_per_user_cohort_time_window": q05_posts_per_user_cohort_time_window,
    "stream_ingest": stream_ingest,
}
