"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables of ``sf_dir`` through the community mapping and
runs over all of their rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.plans.analyses import ANALYSES
from cohortlens.plans.blocks import BLOCKS
from cohortlens.plans.derived import DERIVED
from cohortlens.plans.community import Community
from cohortlens.plans.maintained import MAINTAINED
from cohortlens.session import input_bytes, tune

Query = Callable[[SparkSession, str], DataFrame]


# One saved community per (Spark application, data folder): its base tables are built
# once, by the first query, and read by all later ones.
_COMMUNITIES: dict[tuple[str, str], Community] = {}


def _session_key(spark: SparkSession) -> str:
    app = spark.conf.get("spark.app.id", None)
    return app or str(id(spark))


def community_for(spark: SparkSession, sf_dir: str) -> Community:
    key = (_session_key(spark), sf_dir.rstrip("/"))
    if key not in _COMMUNITIES:
        tune(spark, input_bytes(spark, *[f"{key[1]}/{t}.parquet" for t in ("orders", "lineitem", "part")]))
        _COMMUNITIES[key] = Community.from_fixture(spark, sf_dir, materialize=True).build()
    return _COMMUNITIES[key]


def _on_community(fn, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(community_for(spark, sf_dir), **kw)

    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name, fn in {**BLOCKS, **ANALYSES, **DERIVED, **MAINTAINED}.items():
        out[name] = _on_community(fn)
    return out
