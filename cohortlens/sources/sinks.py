"""Saving results and reading them back; shared scratch space for materialised tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# write dispositions of a saved table
DISPOSITIONS = {
    "empty": "errorifexists",  # fail if the target already holds data
    "truncate": "overwrite",
    "append": "append",
}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for materialised tables: the session's ``spark.checkpoint.dir``.

    On a cluster this must name shared storage and is taken from the session as is.
    Only a local session without the setting gets a fresh temporary folder (tests).
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: only the session conf is visible
        raise RuntimeError("set spark.checkpoint.dir to a shared folder to materialise tables") from None
    root = sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder to materialise tables")
    root = tempfile.mkdtemp(prefix="cohortlens-")
    sc.setCheckpointDir(root)
    return root


# folders of the runs that are on, by application; the last one takes the new tables
_RUNS: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the scratch root, or in the folder of the run that is on."""
    on = _RUNS.get(spark.conf.get("spark.app.id", ""))
    return f"{on[-1] if on else scratch_root(spark) + '/cohortlens'}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_run(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """Tables materialised inside go to one folder, which is removed at the end, after a failure too.

    Results must be saved (or collected) inside: a DataFrame that still reads such a table fails
    afterwards, a community that was built inside as well. Tables saved under other paths
    stay. Runs may be nested; each removes its own folder. The folder is the application's,
    so threads that share a session share it.
    """
    folder = scratch_path(spark, name)
    on = _RUNS.setdefault(spark.conf.get("spark.app.id", ""), [])
    on.append(folder)
    try:
        yield folder
    finally:
        on.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def save(df: DataFrame, path: str, disposition: str = "empty", fmt: str = "parquet",
         partition_by: list[str] | None = None) -> None:
    """Write a result as a table; ``disposition`` is empty / truncate / append."""
    mode = DISPOSITIONS.get(disposition, disposition)
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def materialize(df: DataFrame, name: str, disposition: str = "empty", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to shared scratch storage and return a DataFrame reading it.

    This cuts the lineage (a lost executor re-reads the files instead of recomputing
    the upstream shuffles) and gives the optimizer real size statistics for the table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    save(df, path, disposition, partition_by=partition_by)
    # the schema is known: reading it back needs no footer-inference job
    return spark.read.schema(df.schema).parquet(path)


def fetch_columns(df: DataFrame) -> dict:
    """All rows of a (small, final) result as NumPy columns, via Arrow."""
    pdf = df.toPandas()
    return {c: pdf[c].to_numpy() for c in pdf.columns}


def fetch_pages(df: DataFrame, page_size: int = 10000) -> Iterator[list]:
    """Rows in pages of ``page_size``; only one partition at a time is on the driver."""
    page: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        page.append(row)
        if len(page) == page_size:
            yield page
            page = []
    if page:
        yield page
