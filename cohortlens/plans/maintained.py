"""Registered queries on tables that are kept and changed (stored distinct states, added shards, atomic writes, pages)
and on dumps that are checked or taken apart as they are read (declared schemas, drifting objects, windows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.distinct import LG_K, distinct_count, distinct_states, is_exact, merged_states, relative_error
from cohortlens.operators.dims import USER_COLUMNS
from cohortlens.plans.community import Community
from cohortlens.plans.clustered import buckets_for, save_clustered
from cohortlens.plans.incremental import extended
from cohortlens.operators.clean import clean_posts, clean_submissions
from cohortlens.sources.declared import Declared, read_declared, shredded
from cohortlens.sources.files import read_shards, shard_year, write_shards
from cohortlens.sources.pages import fetch_page, page_index, save_pages
from cohortlens.sources.sinks import scratch_path
from cohortlens.sources.tables import Table
from cohortlens.spec import YEAR_S


def active_values(c: Community) -> DataFrame:
    """kind, cal_month, value of every author and community active in a month, each once."""
    users = c.calendar_cells_plain.select(F.lit("users").alias("kind"), "cal_month", F.col("author").alias("value"))
    return users.unionByName(c.community_cells.select(F.lit("subreddits").alias("kind"), "cal_month", F.col("subreddit").alias("value")))


def active_states(c: Community, n: int, lg_k: int = LG_K) -> DataFrame:
    """The stored state of each month's active authors and communities: their names up to ``n``, and a sketch."""
    return c._keep(distinct_states(active_values(c), ["kind", "cal_month"], "value", n, lg_k, unique=True), "active-states")


def active_threshold(c: Community, n: int = 100) -> DataFrame:
    """Active authors and communities by month and, by merging the months' states, by year: exact up to ``n``; for
    larger counts whether the sketch is ``within`` three standard deviations of the exact one."""
    states = active_states(c, n)
    year = F.expr("cal_month div 12")
    yearly = merged_states(states.withColumn("period", year), ["kind", "period"], n)
    counts = states.select(F.lit("month").alias("grain"), "kind", F.col("cal_month").cast("long").alias("period"), is_exact().alias("exact"), distinct_count().alias("k"))
    counts = counts.unionByName(yearly.select(F.lit("year").alias("grain"), "kind", F.col("period").cast("long").alias("period"), is_exact().alias("exact"), distinct_count().alias("k")))
    values = active_values(c)
    truth = values.groupBy(F.lit("month").alias("grain"), "kind", F.col("cal_month").cast("long").alias("period")).agg(F.count("*").alias("true"))
    in_year = values.select("kind", year.cast("long").alias("period"), "value").distinct()
    truth = truth.unionByName(in_year.groupBy(F.lit("year").alias("grain"), "kind", "period").agg(F.count("*").alias("true")))
    near = F.abs(F.col("k") - F.col("true")) <= 3 * relative_error() * F.col("true")
    return counts.join(truth, ["grain", "kind", "period"], "left").select("grain", "kind", "period", "exact", F.when(F.col("exact"), F.col("k")).alias("n"),
                                                                       F.coalesce(near, F.lit(False)).alias("within"))


def by_shards(c: Community, first_added: int) -> Community:
    """The community built from the shards before a year, then extended by the others (and the rows without a time)."""
    early = F.coalesce(shard_year("created_utc", c.spec) < first_added, F.lit(False))
    start = Community(c.raw_comments.where(early), c.raw_submissions.where(early), c.spec, materialize=True).build()
    return extended(start, c.raw_comments.where(~early), c.raw_submissions.where(~early))


def incremental_users(c: Community) -> DataFrame:
    """The users table after the shards from the middle of the span on are added to those before."""
    return by_shards(c, (c.spec.base_year + c.spec.end_year) // 2).users


def incremental_user_cells(c: Community) -> DataFrame:
    """The user cells after the last shard is added, and after an earlier one is (authors' first posts move)."""
    early = F.coalesce(shard_year("created_utc", c.spec) == c.spec.base_year + 1, F.lit(False))
    late = Community(c.raw_comments.where(~early), c.raw_submissions.where(~early), c.spec, materialize=True)
    return extended(by_shards(late, c.spec.end_year), c.raw_comments.where(early), c.raw_submissions.where(early)).user_cells


def truncate_from_itself(c: Community) -> DataFrame:
    """The users table, saved, appended to, and truncated by a plan that reads it: each user once, one year active or more."""
    spark, users = c.users.sparkSession, c.users.select(*USER_COLUMNS)
    table = Table(spark, scratch_path(spark, "users-table"))
    table.write(users, "empty")
    table.write(users, "append", create="never")
    table.write(table.read().where(F.col("time_active") >= YEAR_S).distinct(), "truncate")
    return table.read()


def clustered_user_cells(c: Community) -> DataFrame:
    """User cells from catalog tables laid out by author, those with more than 50 posts apart."""
    path = scratch_path(c.users.sparkSession, "clustered")
    tables = Community.from_posts(c.posts, c.spec, rows_per_task=50)
    tables.__dict__["users"] = c.users
    return save_clustered(tables, f"cohortlens_{path[-32:]}", path, buckets=buckets_for(c, least=8)).user_cells()


PAGE_SIZE = 500


def page_fetch(c: Community) -> DataFrame:
    """The users table in pages of 500 rows by time of first post and name: every page of the index, and how many rows
    fetching the first, the middle and the last of them gives."""
    spark, path = c.users.sparkSession, scratch_path(c.users.sparkSession, "user-pages")
    save_pages(c.users.select(*USER_COLUMNS), path, ["min_created_utc", "author"], PAGE_SIZE)
    index = page_index(spark, path).select(F.col("_page").alias("page"), "n_rows", F.col("first_key.author").alias("first_author"))
    last = index.agg(F.max("page")).first()[0] or 0
    fetched = [fetch_page(spark, path, p).select(F.lit(p).cast("long").alias("page"), F.lit(1).alias("x")) for p in sorted({0, last // 2, last})]
    counts = fetched[0]
    for f in fetched[1:]:
        counts = counts.unionByName(f)
    return index.join(counts.groupBy("page").agg(F.sum("x").alias("n_fetched")), "page", "left")


SUBMISSION_FIELDS = [
    Declared("who", "RECORD", "REQUIRED", (Declared("author", "STRING", "REQUIRED"), Declared("subreddit"))),
    Declared("texts", "STRING", "REPEATED"),
    Declared("created_utc", "INTEGER"),
]
ANY_NUMBER = 1 << 62  # of bad records


def declared_json(c: Community) -> DataFrame:
    """Submissions as nested JSON lines under a declared schema: records without the required author, with a null among the
    texts, or with a time that is no number are bad."""
    spark, path, t = c.raw_submissions.sparkSession, scratch_path(c.raw_submissions.sparkSession, "submissions-nested"), F.col("created_utc")
    nested = lambda time: F.to_json(F.struct(F.struct("author", "subreddit").alias("who"), F.array("title", "selftext").alias("texts"),
                                             time.alias("created_utc")))
    c.raw_submissions.select(F.when(t % 7 == 0, nested(F.lit("soon"))).otherwise(nested(t)).alias("value")).write.mode("errorifexists").text(path, compression="gzip")
    got = read_declared(spark, path, SUBMISSION_FIELDS, max_bad_records=ANY_NUMBER)
    return got.select(F.col("texts")[0].alias("title"), F.col("texts")[1].alias("selftext"), "who.author", "created_utc", "who.subreddit")


def variant_ingest(c: Community) -> DataFrame:
    """Submissions whose objects drift: some authors are objects with a name, some times are digits in a text or decimal numbers,
    some texts are nested. Shredded and cleaned, they are the posts they were."""
    spark, path = c.raw_submissions.sparkSession, scratch_path(c.raw_submissions.sparkSession, "submissions-drift")
    t, author = F.col("created_utc"), F.col("author")
    line = lambda who, text, time, name: F.to_json(F.struct("title", who, text, time.alias(name), "subreddit", F.lit(3).alias("score")))
    selftext, nested = F.col("selftext"), F.struct(F.col("selftext").alias("text")).alias("body")
    named = F.struct(author.alias("name")).alias("author")
    value = F.when(t % 3 == 0, line(author, selftext, t.cast("string"), "created_utc")).when(t % 5 == 0, line(named, selftext, t, "created")).when(
        t % 7 == 0, line(named, nested, t.cast("double"), "created_utc")).otherwise(line(author, nested, t, "created_utc"))
    c.raw_submissions.select(value.alias("value")).write.mode("errorifexists").text(path, compression="gzip")
    return clean_submissions(shredded(spark.read.text(path), ["title", "selftext", "author", "created_utc", "subreddit"]))


SPAN = (820476000, 915145200)  # 1996-01-01 06:00 to 1998-12-31 23:00


def window_shards(c: Community) -> DataFrame:
    """Both raw logs as yearly shards, read back through an observation window that selects the shards by itself."""
    spark, spec = c.raw_comments.sparkSession, c.spec.with_window(*SPAN)
    paths = scratch_path(spark, "comment-shards"), scratch_path(spark, "submission-shards")
    for raw, path in zip((c.raw_comments, c.raw_submissions), paths):
        write_shards(raw, path, spec)
    return clean_posts(*[read_shards(spark, p, spec=spec) for p in paths])


MAINTAINED = {f.__name__: f for f in (active_threshold, incremental_users, incremental_user_cells, truncate_from_itself, clustered_user_cells, page_fetch, declared_json,
                                    variant_ingest, window_shards)}
