"""Independent SQL (DuckDB dialect) for every registered query.

Written in the direct, per-post form of the analyses (COUNT DISTINCT over the enriched
post table), independently of the Spark code, so agreement checks both the
pre-aggregated cell rewrite and the skew-aware joins. Tables ``orders``, ``lineitem``
and ``part`` are the driver's views.
"""

from __future__ import annotations

from cohortlens.spec import FIXTURE, YEAR_S

S = FIXTURE
THRESHOLD = 100  # of the active_threshold query
O, M, Y, B = S.origin, S.month_s, S.year_s, S.base_year
SEL = ", ".join(str(y) for y in S.selected_cohorts)

# one rule for both streams: a time, and an author who is neither deleted nor a bot by name
KEEP = """created_utc IS NOT NULL AND author NOT IN ('[deleted]')
    AND NOT (author LIKE '%\\_bot' ESCAPE '\\' OR author LIKE '%Bot')
    AND NOT regexp_matches(author, '(?i)transcriber|automoderator')"""

BASE = f"""
o AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, t,
    CAST(o_custkey AS VARCHAR) || '_' || CASE
      WHEN t >= {O} + (o_custkey % 7 + 1 + (o_custkey // 7) % 7) * {YEAR_S} THEN '2'
      WHEN t >= {O} + (o_custkey % 7) * {YEAR_S} THEN '1' ELSE '0' END AS account
  FROM (SELECT *, CAST(epoch(o_orderdate) AS BIGINT) AS t FROM orders)),
ko AS (
  SELECT o_orderkey, o_orderstatus, o_orderpriority, t,
    CASE WHEN o_custkey % 97 = 3 THEN '[deleted]'
         WHEN o_custkey % 89 = 4 THEN 'user_' || account || '_bot'
         WHEN o_custkey % 83 = 5 THEN 'user_' || account || 'Bot'
         WHEN o_custkey % 79 = 6 THEN 'MyTranscriber' || account
         WHEN o_custkey % 73 = 7 THEN 'AutoModerator' || account
         WHEN o_custkey % 71 = 8 THEN NULL
         WHEN o_custkey % 67 = 9 THEN 'user_' || account || 'bot'
         ELSE 'user_' || account END AS author,
    CASE WHEN o_orderkey % 211 = 0 THEN NULL
         ELSE 'sub_' || CAST((((t - {O}) // 86400) * (o_orderkey % 100 + 1)) // 1000 AS VARCHAR)
    END AS subreddit
  FROM o),
raw_submissions AS (
  SELECT o_orderpriority AS title,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL
              ELSE repeat(o_orderstatus, CAST(o_orderkey % 50 AS INTEGER)) END AS selftext,
         author,
         CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE t END AS created_utc,
         subreddit
  FROM ko),
raw_comments AS (
  SELECT CASE WHEN l_partkey % 17 = 0 THEN NULL
              ELSE repeat(p_name, CAST(l_quantity AS INTEGER)) END AS body,
         ko.author,
         CASE WHEN l_suppkey % 101 = 0 THEN NULL
              ELSE ko.t + CAST(l_linenumber AS BIGINT) * 86400 END AS created_utc,
         ko.subreddit
  FROM lineitem JOIN ko ON l_orderkey = ko.o_orderkey JOIN part ON l_partkey = p_partkey),
comments AS (
  SELECT CAST(length(body) AS BIGINT) AS body_size, author, created_utc, subreddit,
         1 AS comment, 0 AS submission
  FROM raw_comments WHERE {KEEP}),
submissions AS (
  SELECT CAST(length(title) + length(selftext) AS BIGINT) AS body_size, author, created_utc,
         subreddit, 0 AS comment, 1 AS submission
  FROM raw_submissions WHERE {KEEP}),
posts AS (SELECT * FROM comments UNION ALL SELECT * FROM submissions),
users AS (
  SELECT author, min(created_utc) AS min_created_utc,
         {B} + (min(created_utc) - {O}) // {Y} AS year,
         max(created_utc) - min(created_utc) AS time_active
  FROM posts GROUP BY author),
subreddits AS (
  SELECT subreddit, min(created_utc) AS min_created_utc FROM posts GROUP BY subreddit),
meta AS (
  SELECT p.body_size, p.author, p.created_utc,
         (p.created_utc - {O}) // {M} AS cal_month,
         {B} + CAST((p.created_utc - {O}) // {M} AS DOUBLE) / 12 AS time,
         p.subreddit, p.comment, p.submission,
         u.min_created_utc AS u_min_created_utc, u.year AS u_year,
         u.time_active AS u_time_active,
         (p.created_utc - u.min_created_utc) // {M} AS user_month,
         CAST((p.created_utc - u.min_created_utc) // {M} AS DOUBLE) / 12 AS u_time,
         s.min_created_utc AS s_min_created_utc,
         u.time_active // {Y} AS survival
  FROM posts p JOIN users u ON p.author = u.author
       JOIN subreddits s ON p.subreddit = s.subreddit)"""


def with_base(*ctes: str) -> str:
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {BASE}{extra}\n"


CAL_X = f"{B} + CAST(cal_month AS DOUBLE) / 12"
USER_X = "CAST(user_month AS DOUBLE) / 12"
PPU = "CAST(count(*) AS DOUBLE) / CAST(count(DISTINCT author) AS DOUBLE)"
LEN = "CAST(sum(body_size) AS DOUBLE) / CAST(count(*) AS DOUBLE)"
CPS = "CAST(sum(comment) AS DOUBLE) / NULLIF(CAST(sum(submission) AS DOUBLE), 0)"
IN_SEL = f"u_year IN ({SEL})"
OVERLAP = f"user_month <= 12 * ({S.end_year} - u_year)"


def _cohort_time(measure: str, src: str, overall_filter: str) -> str:
    return with_base() + f"""
SELECT {CAL_X} AS x, CAST(u_year AS VARCHAR) AS series, {measure} AS y
FROM {src} WHERE {IN_SEL} GROUP BY u_year, cal_month
UNION ALL
SELECT {CAL_X} AS x, 'Overall' AS series, {measure} AS y
FROM {src} WHERE {overall_filter} GROUP BY cal_month"""


def _cohort_utime(measure: str, src: str) -> str:
    return with_base() + f"""
SELECT {USER_X} AS x, CAST(u_year AS VARCHAR) AS series, {measure} AS y
FROM {src} WHERE {IN_SEL} GROUP BY u_year, user_month HAVING {OVERLAP}"""


def _survival(measure: str, src: str, cohorts: tuple[int, ...]) -> str:
    years = ", ".join(str(y) for y in cohorts)
    return with_base() + f"""
SELECT u_year AS cohort, {USER_X} AS x, CAST(survival AS VARCHAR) AS series, {measure} AS y
FROM {src} WHERE u_year IN ({years}) GROUP BY u_year, survival, user_month"""


CMETA = "(SELECT * FROM meta WHERE comment = 1)"

Q = {
    "q01_cumulative_growth": with_base(
        f"""firsts AS (
  SELECT 'Cumulative number of users' AS series, (min_created_utc - {O}) // {M} AS m FROM users
  UNION ALL
  SELECT 'Cumulative number of subreddits' AS series, (min_created_utc - {O}) // {M} AS m
  FROM subreddits)""",
        "counts AS (SELECT series, m, count(*) AS n FROM firsts GROUP BY series, m)",
    )
    + f"""
SELECT {B} + CAST(m AS DOUBLE) / 12 AS x, series,
       CAST(sum(n) OVER (PARTITION BY series ORDER BY m
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS y
FROM counts""",
    "q02_active_monthly": with_base()
    + f"""
SELECT {CAL_X} AS x, 'Number of active users' AS series,
       CAST(count(DISTINCT author) AS DOUBLE) AS y FROM meta GROUP BY cal_month
UNION ALL
SELECT {CAL_X} AS x, 'Number of active subreddits' AS series,
       CAST(count(DISTINCT subreddit) AS DOUBLE) AS y FROM meta GROUP BY cal_month""",
    "q03_posts_per_user_time": with_base()
    + f"""
SELECT {CAL_X} AS x, 'Number of posts per surviving user' AS series, {PPU} AS y
FROM meta GROUP BY cal_month""",
    "q04_posts_per_user_utime": with_base()
    + f"""
SELECT {USER_X} AS x, 'Overall' AS series, {PPU} AS y
FROM meta GROUP BY user_month HAVING user_month <= {S.max_user_month}""",
    "q05_posts_per_user_cohort_time": _cohort_time(PPU, "meta", "TRUE"),
    "q06_posts_per_user_cohort_utime": _cohort_utime(PPU, "meta"),
    "q07_posts_per_user_survival": _survival(PPU, "meta", S.survival_cohorts),
    "q08_comment_len_cohort_time": _cohort_time(LEN, CMETA, "TRUE"),
    "q09_comment_len_cohort_utime": _cohort_utime(LEN, CMETA),
    "q10_comment_len_survival": _survival(LEN, CMETA, S.survival_cohorts),
    "q11_ratio_cohort_time": _cohort_time(CPS, "meta", IN_SEL),
    "q12_ratio_cohort_utime": _cohort_utime(CPS, "meta"),
    "q13_ratio_survival": _survival(CPS, "meta", S.ratio_survival_cohorts),
}

# ---- building blocks, sources and sinks ------------------------------------------

RAW_UNION = """
SELECT CAST(length(body) AS BIGINT) AS body_size, author, created_utc, subreddit,
       1 AS comment, 0 AS submission FROM raw_comments
UNION ALL
SELECT CAST(length(title) + length(selftext) AS BIGINT) AS body_size, author, created_utc,
       subreddit, 0 AS comment, 1 AS submission FROM raw_submissions"""

FIRST_SEL, END_START = S.year_start(S.first_cohort), S.year_start(S.end_year)



def in_window(sql: str) -> str:
    """The same query over posts of an observation window only."""
    every = "posts AS (SELECT * FROM comments UNION ALL SELECT * FROM submissions)"
    assert every in sql
    return sql.replace(every, every[:-1].replace("SELECT * FROM comments", "SELECT * FROM (SELECT * FROM comments", 1)
                       + ") AS p WHERE created_utc BETWEEN 820476000 AND 915145199)")


BLOCKS = {
    "clean_posts": with_base() + "SELECT * FROM posts",
    "posts_union": with_base() + RAW_UNION,
    "users_dim": with_base() + "SELECT * FROM users",
    "subreddits_dim": with_base() + "SELECT * FROM subreddits",
    "enrich_posts": with_base() + "SELECT * EXCLUDE (survival) FROM meta",
    "calendar_cells": with_base()
    + """
SELECT author, cal_month, count(*) AS n_posts, CAST(sum(comment) AS BIGINT) AS n_comments,
       CAST(sum(submission) AS BIGINT) AS n_submissions,
       CAST(sum(CASE WHEN comment = 1 THEN body_size END) AS BIGINT) AS sum_comment_size,
       u_year, survival AS u_survival
FROM meta GROUP BY author, cal_month, u_year, survival""",
    "user_cells": with_base()
    + """
SELECT author, u_year, survival AS u_survival, user_month, count(*) AS n_posts,
       CAST(sum(comment) AS BIGINT) AS n_comments, CAST(sum(submission) AS BIGINT) AS n_submissions,
       CAST(sum(CASE WHEN comment = 1 THEN body_size END) AS BIGINT) AS sum_comment_size
FROM meta GROUP BY author, u_year, survival, user_month""",
    "community_cells": with_base()
    + "SELECT subreddit, cal_month, count(*) AS n_posts FROM meta GROUP BY subreddit, cal_month",
    "window_filter": with_base()
    + f"SELECT * FROM posts WHERE created_utc >= {FIRST_SEL} AND created_utc < {END_START}",
    "scan_union_shards": with_base()
    # all shards of the study, from its first year (1995) to its last (2001), on its own clock
    + "SELECT * FROM posts WHERE created_utc >= 788918400 AND created_utc < 788918400 + 7 * 31557600",
    "json_ingest": with_base() + "SELECT * FROM posts",
    "csv_ingest": with_base() + "SELECT * FROM posts",
    "json_cells": with_base() + "SELECT created_utc, author, subreddit, title, selftext FROM raw_submissions",
    "json_bad_records": with_base() + "SELECT * FROM comments WHERE created_utc % 7 <> 0 AND created_utc % 11 <> 0",
    "csv_bad_records": with_base() + "SELECT * FROM submissions WHERE created_utc % 7 <> 0 AND created_utc % 11 <> 0",
    "write_dispositions": with_base() + "SELECT * FROM users UNION ALL SELECT * FROM users",
    "enrich_posts_salted": with_base() + "SELECT * EXCLUDE (survival) FROM meta",
    "q02_active_monthly_window": in_window(Q["q02_active_monthly"]),
    "q05_posts_per_user_cohort_time_window": in_window(Q["q05_posts_per_user_cohort_time"]),
    "materialize_roundtrip": with_base() + "SELECT * FROM users",
    "stream_ingest": with_base() + "SELECT * FROM submissions",
}

# ---- derived analyses --------------------------------------------------------------

REASON = """CASE WHEN created_utc IS NULL THEN 'null_time'
         WHEN author IS NULL OR author = '[deleted]' THEN 'deleted_author'
         WHEN right(author, 4) = '_bot' OR right(author, 3) = 'Bot' THEN 'bot_suffix'
         WHEN contains(lower(author), 'transcriber')
           OR contains(lower(author), 'automoderator') THEN 'bot_word' END"""

YEAR_OF = f"{B} + cal_month // 12"

DERIVED = {
    "active_approx": f"SELECT x, series, y, TRUE AS within FROM ({Q['q02_active_monthly']})",
    "cohort_year_matrix": with_base()
    + f"""
SELECT {YEAR_OF} AS year, CAST(u_year AS VARCHAR) AS cohort, {LEN} AS y
FROM {CMETA} GROUP BY {YEAR_OF}, u_year
UNION ALL
SELECT {YEAR_OF} AS year, 'Overall' AS cohort, {LEN} AS y
FROM {CMETA} GROUP BY {YEAR_OF}""",
    "cohort_year_matrix_wide": with_base()
    + f"""
SELECT {YEAR_OF} AS year,
"""
    + ",\n".join(
        f"  CAST(sum(body_size) FILTER (WHERE u_year = {y}) AS DOUBLE)"
        f" / CAST(count(*) FILTER (WHERE u_year = {y}) AS DOUBLE) AS \"{y}\""
        for y in range(B, S.end_year + 1)
    )
    + f""",
  {LEN} AS "Overall"
FROM {CMETA} GROUP BY {YEAR_OF}""",
    "dataset_totals": with_base(
        f"""reasons AS (
  SELECT 1 AS comment, 0 AS submission, {REASON} AS reason FROM raw_comments
  UNION ALL
  SELECT 0 AS comment, 1 AS submission, {REASON} AS reason FROM raw_submissions)"""
    )
    + """
SELECT CAST(sum(comment) AS BIGINT) AS raw_comments,
       CAST(sum(submission) AS BIGINT) AS raw_submissions,
       count(*) FILTER (WHERE reason IS NULL AND comment = 1) AS clean_comments,
       count(*) FILTER (WHERE reason IS NULL AND submission = 1) AS clean_submissions,
       count(*) FILTER (WHERE reason = 'null_time') AS dropped_null_time,
       count(*) FILTER (WHERE reason = 'deleted_author') AS dropped_deleted_author,
       count(*) FILTER (WHERE reason = 'bot_suffix') AS dropped_bot_suffix,
       count(*) FILTER (WHERE reason = 'bot_word') AS dropped_bot_word,
       (SELECT count(*) FROM users) AS n_users,
       (SELECT count(subreddit) FROM subreddits) AS n_subreddits
FROM reasons""",
    "active_fraction": with_base(
        f"""firsts AS (
  SELECT 'users' AS kind, (min_created_utc - {O}) // {M} AS m, count(*) AS n FROM users GROUP BY 2
  UNION ALL
  SELECT 'subreddits' AS kind, (min_created_utc - {O}) // {M} AS m, count(*) AS n
  FROM subreddits GROUP BY 2)""",
        """act AS (
  SELECT 'users' AS kind, cal_month AS m, count(DISTINCT author) AS a FROM meta GROUP BY cal_month
  UNION ALL
  SELECT 'subreddits' AS kind, cal_month AS m, count(DISTINCT subreddit) AS a
  FROM meta GROUP BY cal_month)""",
        """allm AS (
  SELECT kind, m, sum(n) AS n, sum(a) AS a
  FROM (SELECT kind, m, n, 0 AS a FROM firsts UNION ALL SELECT kind, m, 0 AS n, a FROM act)
  GROUP BY kind, m)""",
        """cum AS (
  SELECT kind, m, a,
         sum(n) OVER (PARTITION BY kind ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
  FROM allm)""",
    )
    + f"""
SELECT {B} + CAST(m AS DOUBLE) / 12 AS x,
       CASE WHEN kind = 'users' THEN 'Active fraction of users'
            ELSE 'Active fraction of subreddits' END AS series,
       CAST(a AS DOUBLE) / CAST(c AS DOUBLE) AS y
FROM cum WHERE a > 0""",
    "cohort_share": with_base(
        f"""g AS (
  SELECT {YEAR_OF} AS year, u_year AS cohort, CAST(sum(comment) AS BIGINT) AS n_comments,
         count(DISTINCT author) AS n_users
  FROM meta GROUP BY {YEAR_OF}, u_year)"""
    )
    + """
SELECT year, cohort, n_comments,
       CAST(n_comments AS DOUBLE)
         / NULLIF(CAST(sum(n_comments) OVER (PARTITION BY year) AS DOUBLE), 0) AS comment_share,
       n_users,
       CAST(n_users AS DOUBLE) / CAST(sum(n_users) OVER (PARTITION BY year) AS DOUBLE) AS user_share
FROM g""",
    "heavy_authors": with_base(f"ru AS ({RAW_UNION})")
    + """
SELECT author, count(*) AS n_posts,
       CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) FROM ru) AS DOUBLE) AS share
FROM ru WHERE author IS NOT NULL
GROUP BY author ORDER BY n_posts DESC, author ASC LIMIT 20""",
    "simpson_check": with_base(
        f"""q AS (
  SELECT {CAL_X} AS x, CAST(u_year AS VARCHAR) AS series, {LEN} AS y
  FROM {CMETA} WHERE {IN_SEL} GROUP BY u_year, cal_month
  UNION ALL
  SELECT {CAL_X} AS x, 'Overall' AS series, {LEN} AS y FROM {CMETA} GROUP BY cal_month)""",
        "sl AS (SELECT series, regr_slope(y, x) AS slope FROM q GROUP BY series)",
    )
    + """
SELECT series, round(slope, 6) AS slope, CAST(sign(slope) AS INTEGER) AS trend,
       CAST(sign((SELECT slope FROM sl WHERE series = 'Overall')) AS INTEGER) AS overall_trend,
       CAST(sign(slope) AS INTEGER)
         * CAST(sign((SELECT slope FROM sl WHERE series = 'Overall')) AS INTEGER) < 0 AS reversal
FROM sl WHERE series <> 'Overall'""",
    "cohort_retention": with_base(
        "sizes AS (SELECT year AS u_year, count(*) AS size FROM users GROUP BY year)",
        f"""act AS (
  SELECT u_year, user_month, count(DISTINCT author) AS a FROM meta WHERE {IN_SEL}
  GROUP BY u_year, user_month HAVING {OVERLAP})""",
    )
    + f"""
SELECT {USER_X} AS x, CAST(u_year AS VARCHAR) AS series, CAST(a AS DOUBLE) / CAST(size AS DOUBLE) AS y
FROM act JOIN sizes USING (u_year)""",
    "survival_distribution": with_base(
        f"""g AS (SELECT year AS cohort, time_active // {Y} AS survival, count(*) AS n_users
  FROM users GROUP BY year, time_active // {Y})"""
    )
    + """
SELECT cohort, survival, n_users,
       CAST(n_users AS DOUBLE) / CAST(sum(n_users) OVER (PARTITION BY cohort) AS DOUBLE) AS share
FROM g""",
    "low_activity_survivors": with_base(
        """pa AS (
  SELECT author, u_year, count(*) AS n, count(DISTINCT cal_month) AS months
  FROM meta WHERE survival >= 1 GROUP BY author, u_year)"""
    )
    + """
SELECT u_year AS cohort, count(*) AS n_survivors, count(*) FILTER (WHERE n <= 2 * months) AS n_low,
       CAST(count(*) FILTER (WHERE n <= 2 * months) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS share_low
FROM pa GROUP BY u_year""",
    "low_activity_months": with_base(
        """am AS (
  SELECT author, u_year, survival, cal_month, count(*) AS n
  FROM meta WHERE survival >= 1 GROUP BY author, u_year, survival, cal_month)"""
    )
    + """
SELECT u_year AS cohort, survival, count(*) AS n_months, count(*) FILTER (WHERE n <= 2) AS n_low,
       CAST(count(*) FILTER (WHERE n <= 2) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS share_low
FROM am GROUP BY u_year, survival""",
    "initial_level_by_survival": with_base()
    + f"""
SELECT u_year AS cohort, survival, {PPU} AS posts_per_user,
       CAST(sum(CASE WHEN comment = 1 THEN body_size END) AS DOUBLE)
         / NULLIF(CAST(sum(comment) AS DOUBLE), 0) AS comment_length,
       {CPS} AS comments_per_submission
FROM meta WHERE user_month = 0 GROUP BY u_year, survival""",
    "first_year_growth": with_base(
        f"""q AS (
  SELECT u_year AS cohort, user_month, CAST(survival AS VARCHAR) AS series, {CPS} AS y
  FROM meta WHERE u_year IN ({", ".join(str(y) for y in S.ratio_survival_cohorts)})
  GROUP BY u_year, survival, user_month)"""
    )
    + """
SELECT cohort, series, max(CASE WHEN user_month = 0 THEN y END) AS y0,
       max(CASE WHEN user_month = 12 THEN y END) AS y12,
       max(CASE WHEN user_month = 12 THEN y END)
         / NULLIF(max(CASE WHEN user_month = 0 THEN y END), 0) AS growth
FROM q GROUP BY cohort, series""",
    "entry_vs_prior_overall": with_base(
        f"""q AS (SELECT cal_month AS month, CAST(u_year AS VARCHAR) AS series, {LEN} AS y
  FROM {CMETA} WHERE {IN_SEL} GROUP BY u_year, cal_month)""",
        f"ov AS (SELECT cal_month + 1 AS month, {LEN} AS y_prior_overall FROM {CMETA} GROUP BY cal_month)",
        "entry AS (SELECT series, min(month) AS month, arg_min(y, month) AS y_entry FROM q GROUP BY series)",
    )
    + f"""
SELECT series, {B} + CAST(entry.month AS DOUBLE) / 12 AS x, y_entry, y_prior_overall,
       y_entry - y_prior_overall AS diff
FROM entry LEFT JOIN ov ON entry.month = ov.month""",
    "cumulative_share": with_base(
        f"""firsts AS (
  SELECT 'Cumulative number of users' AS series, (min_created_utc - {O}) // {M} AS m FROM users
  UNION ALL
  SELECT 'Cumulative number of subreddits' AS series, (min_created_utc - {O}) // {M} AS m
  FROM subreddits)""",
        "counts AS (SELECT series, m, count(*) AS n FROM firsts GROUP BY series, m)",
    )
    + f"""
SELECT {B} + CAST(m AS DOUBLE) / 12 AS x, series,
       CAST(sum(n) OVER (PARTITION BY series ORDER BY m
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
       / CAST(sum(n) OVER (PARTITION BY series) AS DOUBLE) AS y
FROM counts""",
    "normalize_sum": "SELECT x, series, y / sum(y) OVER (PARTITION BY series) AS y FROM ("
    + Q["q02_active_monthly"]
    + ")",
    "normalize_max": "SELECT x, series, y / max(y) OVER (PARTITION BY series) AS y FROM ("
    + Q["q05_posts_per_user_cohort_time"]
    + ")",
    "normalize_x": "SELECT x / max(x) OVER (PARTITION BY series) AS x, series, y FROM ("
    + Q["q06_posts_per_user_cohort_utime"]
    + ")",
}


MAINTAINED = {
    "active_threshold": with_base("""v AS (
  SELECT 'users' AS kind, cal_month, author AS v FROM meta UNION ALL SELECT 'subreddits', cal_month, subreddit FROM meta)""",
                                  """k AS (
  SELECT 'month' AS grain, kind, cal_month AS period, count(DISTINCT v) AS k FROM v GROUP BY kind, cal_month
  UNION ALL SELECT 'year', kind, cal_month // 12, count(DISTINCT v) FROM v GROUP BY kind, cal_month // 12)""")
    + f"""
SELECT grain, kind, CAST(period AS BIGINT) AS period, k <= {THRESHOLD} AS exact, CASE WHEN k <= {THRESHOLD} THEN k END AS n, TRUE AS within FROM k""",
    "incremental_users": with_base() + "SELECT author, min_created_utc, year, time_active, time_active // " + str(Y) + """ AS survival,
       (SELECT count(*) FROM posts p WHERE p.author = users.author) AS n_posts FROM users""",
    "incremental_user_cells": BLOCKS["user_cells"],
    "clustered_user_cells": BLOCKS["user_cells"],
    "page_fetch": with_base("""r AS (SELECT author, row_number() OVER (ORDER BY min_created_utc, author) - 1 AS n FROM users)""",
                            """k AS (SELECT n // 500 AS page, count(*) AS n_rows, min_by(author, n) AS first_author FROM r GROUP BY n // 500)""")
    + """
SELECT page, n_rows, first_author, CASE WHEN page IN (0, (SELECT max(page) // 2 FROM k), (SELECT max(page) FROM k)) THEN n_rows END AS n_fetched FROM k""",
    "declared_json": with_base() + """SELECT title, selftext, author, created_utc, subreddit FROM raw_submissions
WHERE author IS NOT NULL AND title IS NOT NULL AND selftext IS NOT NULL AND (created_utc IS NULL OR created_utc % 7 <> 0)""",
    "variant_ingest": with_base() + "SELECT * FROM submissions",
    "window_shards": with_base() + "SELECT * FROM posts WHERE created_utc >= 820476000 AND created_utc < 915145200",
    "truncate_from_itself": with_base() + f"SELECT author, min_created_utc, year, time_active FROM users WHERE time_active >= {Y}",
}


def oracle_sql() -> dict[str, str]:
    return {**BLOCKS, **Q, **DERIVED, **MAINTAINED}
