"""The public entry point: a community log with its derived tables and measures.

    community = Community(raw_comments, raw_submissions, REDDIT)
    community.metric("comment_length", clock="user", by="cohort", overlap=True)

Members are DataFrames, so a caller's extra filters and projections still reach the scans.
Base tables are saved on first use with ``materialize``, lazy otherwise; the skew-safe
joins (user cells, enriched posts) count the heavy keys of their dimension when the plan
is built, so save the base tables before using them on a large log.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.clocks import calendar_x, survival_years, user_x
from cohortlens.operators.clean import POST_COLUMNS, apply_window, clean_posts
from cohortlens.operators.dims import subreddits_from_cells, users_from_cells
from cohortlens.operators.enrich import enrich_posts
from cohortlens.operators.facts import (
    CELL_MEASURES,
    author_month_cells,
    calendar_cells,
    community_month_cells,
    month_cells,
    user_cells,
)
from cohortlens.operators.measures import MEASURES, Measure
from cohortlens.operators.series import as_series, ordered
from cohortlens.sources import fixture
from cohortlens.sources.sinks import materialize as save_and_reread
from cohortlens.sources.sinks import save
from cohortlens.spec import FIXTURE, CohortSpec

OVERALL = "Overall"


class Community:
    def __init__(
        self,
        raw_comments: DataFrame,
        raw_submissions: DataFrame,
        spec: CohortSpec,
        skew_safe: bool = True,
        materialize: bool = False,
        rows_per_task: int = 4_000_000,
        max_hot: int = 10_000,
        persist: bool = False,
    ):
        """Raw comments / submissions (see ``sources.files`` for their schemas) and a spec.

        ``materialize``: save the base tables (cleaned posts, month cells, users,
        communities, calendar and user cells) to the shared scratch folder
        (``spark.checkpoint.dir``) on first use and read them back, like a warehouse job
        that builds its base tables once and runs every analysis on them. The raw logs
        are then parsed and cleaned once per Community instead of once per branch of each
        plan, the analyses read compact cell tables, and a lost executor re-reads files
        instead of recomputing upstream shuffles.
        ``persist``: without ``materialize``, keep the base tables in executor memory /
        disk (``persist``) instead of recomputing them for every plan that uses them;
        lost blocks are recomputed from lineage.
        ``skew_safe`` / ``rows_per_task`` / ``max_hot``: the salted per-post join."""
        self.raw_comments = raw_comments
        self.raw_submissions = raw_submissions
        self.spec = spec
        self.skew_safe = skew_safe
        self.materialize = materialize
        self.persist = persist
        # skew-aware join: keys with more rows than this are spread over several tasks;
        # at most max_hot keys are treated as hot (that list is what gets broadcast)
        self.skew = {"rows_per_task": rows_per_task, "max_hot": max_hot} if skew_safe else None

    @classmethod
    def from_fixture(cls, spark: SparkSession, sf_dir: str, spec: CohortSpec = FIXTURE, **kw) -> "Community":
        """The community derived from the driver's order tables (see sources/fixture.py)."""
        comments, submissions = fixture.community(spark, sf_dir)
        return cls(comments, submissions, spec, **kw)

    @classmethod
    def from_posts(cls, posts: DataFrame, spec: CohortSpec, **kw) -> "Community":
        """A Community over an already cleaned post table (e.g. the sink of
        ``streaming.ingest``); analyses of raw rows (dataset totals, heavy authors) need
        the raw dumps and are unavailable."""
        c = cls(None, None, spec, **kw)
        c.__dict__["posts"] = apply_window(posts.select(*POST_COLUMNS), spec)
        return c

    # ---- base tables -------------------------------------------------------------

    def _keep(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """A base table as built: saved and re-read, persisted, or left lazy."""
        if self.materialize:
            return save_and_reread(df, name, partition_by=partition_by)
        if self.persist:
            return df.persist(StorageLevel.MEMORY_AND_DISK)
        return df

    @cached_property
    def posts(self) -> DataFrame:
        """Cleaned comments UNION ALL cleaned submissions, inside the observation window."""
        posts = apply_window(clean_posts(self.raw_comments, self.raw_submissions), self.spec)
        return self._keep(posts, "posts")

    @property
    def comments(self) -> DataFrame:
        return self.posts.where(F.col("comment") == 1)

    @cached_property
    def month_cells(self) -> DataFrame:
        """One pass over the posts: (author, month) and (community, month) cells."""
        cells = month_cells(self.posts, self.spec)
        return self._keep(cells, "month-cells", partition_by=["kind"])

    @property
    def author_cells(self) -> DataFrame:
        return author_month_cells(self.month_cells)

    @cached_property
    def users(self) -> DataFrame:
        """author, min_created_utc, year, time_active, survival, n_posts (from the cells)."""
        users = users_from_cells(self.author_cells, self.spec)
        return self._keep(users, "users")

    @cached_property
    def subreddits(self) -> DataFrame:
        """subreddit, min_created_utc, n_posts; one NULL row for posts without community."""
        subreddits = subreddits_from_cells(community_month_cells(self.month_cells))
        return self._keep(subreddits, "subreddits")

    def meta(self) -> DataFrame:
        """The wide enriched post table (posts ⋈ users ⋈ subreddits + clocks)."""
        return enrich_posts(self.posts, self.users, self.subreddits, self.spec, self.skew)

    # ---- saved base tables ---------------------------------------------------------

    BASE_TABLES = ("posts", "month_cells", "users", "subreddits", "calendar_cells", "user_cells")
    # dependency waves of the base tables; the tables inside one wave are independent
    BUILD_WAVES = (("posts",), ("month_cells",), ("users", "subreddits"), ("calendar_cells", "user_cells"))

    def build(self, parallel: bool = True) -> "Community":
        """Build every base table now (saved when ``materialize``), wave by wave; the
        independent tables of a wave are submitted as concurrent Spark jobs from driver
        threads, so their small stages overlap on the cluster."""
        from concurrent.futures import ThreadPoolExecutor

        for wave in self.BUILD_WAVES:
            if parallel and len(wave) > 1:
                with ThreadPoolExecutor(len(wave)) as pool:
                    list(pool.map(lambda name: getattr(self, name), wave))
            else:
                for name in wave:
                    getattr(self, name)
        return self

    def save_tables(self, root: str, disposition: str = "empty") -> None:
        """Write the base tables under ``root`` (one parquet folder each), so later
        sessions can run every analysis with ``open_tables`` and no recomputation.
        ``disposition``: 'empty' (fail if present), 'truncate' or 'append'."""
        for name in self.BASE_TABLES:
            parts = ["kind"] if name == "month_cells" else None  # as built: each kind is read alone
            save(getattr(self, name), f"{root.rstrip('/')}/{name}", disposition, partition_by=parts)

    @classmethod
    def open_tables(cls, spark: SparkSession, root: str, spec: CohortSpec, **kw) -> "Community":
        """A Community over base tables written by ``save_tables``; the raw logs are not
        needed (analyses of raw rows — dataset totals, heavy authors — are unavailable)."""
        c = cls(None, None, spec, **kw)
        for name in cls.BASE_TABLES:
            c.__dict__[name] = spark.read.parquet(f"{root.rstrip('/')}/{name}")
        return c

    # ---- pre-aggregated cells ----------------------------------------------------

    @cached_property
    def calendar_cells(self) -> DataFrame:
        """(author, cal_month) cells inside communities, with cohort and survival."""
        cells = calendar_cells(self.author_cells, self.users)
        return self._keep(cells, "calendar-cells")

    @property
    def calendar_cells_plain(self) -> DataFrame:
        """(author, cal_month) cells inside communities, without user attributes."""
        return self.author_cells.where(F.col("in_community")).select("author", "cal_month", *CELL_MEASURES)

    @property
    def community_cells(self) -> DataFrame:
        """(subreddit, cal_month) cells: the communities active in each month."""
        return (
            community_month_cells(self.month_cells)
            .where(F.col("subreddit").isNotNull())
            .select("subreddit", "cal_month", "n_posts")
        )

    @cached_property
    def user_cells(self) -> DataFrame:
        """(author, user_month) cells with the author's cohort and survival."""
        cells = user_cells(self.posts, self.users, self.spec, self.skew)
        return self._keep(cells, "user-cells")

    # ---- measures ----------------------------------------------------------------

    def metric(
        self,
        measure: str | Measure,
        clock: str = "calendar",
        by: str | None = None,
        *,
        cohorts: tuple[int, ...] | None = None,
        overall: bool = False,
        overall_scope: str = "all",
        overlap: bool = False,
        strict: bool = False,
        max_user_month: int | None = None,
        label: str = OVERALL,
        method: str = "cells",
        order: bool = True,
        keep_month: bool = False,
    ) -> DataFrame:
        """One measure as series ``(x, series, y)``; ``by='survival'`` adds ``cohort``.

        clock:   'calendar' (months since origin) or 'user' (months since first post)
        by:      None (one series named ``label``), 'cohort', or 'survival'
        cohorts: cohorts to keep (default: the spec's selected / survival cohorts)
        overall: with by='cohort', add an 'Overall' series computed in the same
                 aggregation (GROUPING SETS); overall_scope 'all' uses every author,
                 'selected' only the selected cohorts
        overlap: keep user months every member of a cohort can reach:
                 user_month <= 12*(end_year - cohort) (``strict``: <)
        method:  'cells' (pre-aggregated, default) or 'direct' (COUNT DISTINCT on posts)
        keep_month: also return the integer month index as column ``month``
        """
        m = MEASURES[measure] if isinstance(measure, str) else measure
        spec = self.spec
        month = "cal_month" if clock == "calendar" else "user_month"
        if clock not in ("calendar", "user"):
            raise ValueError(f"unknown clock {clock!r}")

        if method == "cells":
            if clock == "calendar":
                src = self.calendar_cells_plain if by is None else self.calendar_cells
            else:
                src = self.user_cells
            flt = m.cell_filter()
            y = m.from_cells()
        elif method == "direct":
            src = self.meta().withColumn("u_survival", survival_years("u_time_active", spec))
            flt = m.post_filter()
            y = m.direct()
        else:
            raise ValueError(f"unknown method {method!r}")
        if flt is not None:
            src = src.where(flt)

        x = calendar_x(month, spec) if clock == "calendar" else user_x(month)
        keys = [F.col(month).alias("month")] if keep_month else []
        cap = F.lit(True) if max_user_month is None else F.col(month) <= F.lit(max_user_month)

        if by is None:
            g = src.groupBy(month).agg(y.alias("y")).where(cap)
            out = as_series(g, x, F.lit(label), F.col("y"), *keys)
        elif by == "cohort":
            selected = list(cohorts or spec.selected_cohorts)
            in_sel = F.col("u_year").isin(selected)
            if overall:
                base = src if overall_scope == "all" else src.where(in_sel)
                g = base.groupingSets([["u_year", month], [month]], "u_year", month).agg(
                    y.alias("y"), F.grouping("u_year").alias("_overall")
                )
                is_overall = F.col("_overall") == 1
                g = g.where(is_overall | in_sel)
            else:
                g = src.where(in_sel).groupBy("u_year", month).agg(y.alias("y"))
                is_overall = F.lit(False)
            if overlap:
                reach = F.lit(12) * (F.lit(spec.end_year) - F.col("u_year"))
                keep = F.col(month) < reach if strict else F.col(month) <= reach
                g = g.where(is_overall | keep)
            g = g.where(cap)
            series = F.when(is_overall, F.lit(OVERALL)).otherwise(F.col("u_year").cast("string"))
            out = as_series(g, x, series, F.col("y"), *keys)
        elif by == "survival":
            chosen = list(cohorts or spec.survival_cohorts)
            g = (
                src.where(F.col("u_year").isin(chosen))
                .groupBy("u_year", "u_survival", month)
                .agg(y.alias("y"))
                .where(cap)
            )
            out = as_series(
                g.withColumnRenamed("u_year", "cohort"), x, F.col("u_survival"), F.col("y"), "cohort", *keys
            )
        else:
            raise ValueError(f"unknown grouping {by!r}")
        return ordered(out) if order else out
