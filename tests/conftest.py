import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from cohortlens.session import tune

    b = (
        SparkSession.builder.master("local[*]")
        .appName("cohortlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    # tests set their own checkpoint folder only where the environment gives none
    if not (s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlens-test-"))
    tune(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_community(spark):
    from cohortlens.plans.community import Community

    # saved base tables, built once for the session (the lazy path has its own tests)
    return Community.from_fixture(spark, SMALL, materialize=True)


def _null_first(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


def rows(df, *cols):
    """All rows as tuples of ``cols``, sorted (NULLs first), for order-free comparison."""
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_null_first)
