"""Run the study end to end on raw dumps and write every result as a table.

    python -m cohortlens --comments 'dumps/comments/*.json' --submissions 'dumps/subs/*.json' \\
        --out /shared/results [--format json|parquet|csv|shards] [--spec reddit|fixture] \\
        [--only q05_posts_per_user_cohort_time,q08_comment_len_cohort_time] [--tables DIR]

The base tables are built once (and kept under ``--tables`` if given, for later runs with
``--reuse``); each analysis is then written to ``<out>/<name>``.
"""

from __future__ import annotations

import argparse
import sys

from cohortlens.plans.analyses import ANALYSES
from cohortlens.plans.community import Community
from cohortlens.plans.derived import DERIVED
from cohortlens.session import input_bytes, tune
from cohortlens.sources.files import read_csv, read_json, read_shards
from cohortlens.sources.sinks import save
from cohortlens.spec import FIXTURE, REDDIT

SPECS = {"reddit": REDDIT, "fixture": FIXTURE}
RAW_ONLY = {"dataset_totals", "heavy_authors"}


def _read(spark, fmt: str, path: str, kind: str):
    if fmt == "json":
        return read_json(spark, path, kind)
    if fmt == "csv":
        return read_csv(spark, path, kind)
    if fmt == "shards":
        return read_shards(spark, path)
    return spark.read.parquet(path)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="cohortlens", description=__doc__.split("\n\n")[0])
    ap.add_argument("--comments")
    ap.add_argument("--submissions")
    ap.add_argument("--format", default="json", choices=["json", "parquet", "csv", "shards"])
    ap.add_argument("--spec", default="reddit", choices=sorted(SPECS))
    ap.add_argument("--out", required=True)
    ap.add_argument("--only", default="")
    ap.add_argument("--tables", help="folder to save the base tables in (or read them from with --reuse)")
    ap.add_argument("--reuse", action="store_true", help="open saved base tables instead of raw dumps")
    ap.add_argument("--disposition", default="empty", choices=["empty", "truncate", "append"])
    args = ap.parse_args(argv)

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("cohortlens").getOrCreate()
    spec = SPECS[args.spec]
    if args.reuse:
        if not args.tables:
            ap.error("--reuse needs --tables")
        tune(spark, input_bytes(spark, args.tables))
        community = Community.open_tables(spark, args.tables, spec)
    else:
        if not (args.comments and args.submissions):
            ap.error("--comments and --submissions are required unless --reuse is given")
        tune(spark, input_bytes(spark, args.comments, args.submissions))
        community = Community(
            _read(spark, args.format, args.comments, "comment"),
            _read(spark, args.format, args.submissions, "submission"),
            spec,
            materialize=True,
        )
        if args.tables:
            community.save_tables(args.tables, args.disposition)

    jobs = {**ANALYSES, **DERIVED}
    names = [n for n in args.only.split(",") if n] or list(jobs)
    unknown = [n for n in names if n not in jobs]
    if unknown:
        ap.error(f"unknown analyses: {', '.join(unknown)}")
    for name in names:
        if args.reuse and name in RAW_ONLY:
            print(f"skip {name}: needs the raw dumps", file=sys.stderr)
            continue
        save(jobs[name](community), f"{args.out.rstrip('/')}/{name}", args.disposition)
        print(f"wrote {name}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
