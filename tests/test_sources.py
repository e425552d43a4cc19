"""File sources and sinks: JSON/CSV with fixed schemas, shards, dispositions."""

import pytest
from pyspark.sql import functions as F

from cohortlens.sources.files import RAW_COMMENT_SCHEMA, read_csv, read_json, read_shards, write_shards
from cohortlens.sources.sinks import fetch_columns, fetch_pages, save
from cohortlens.spec import REDDIT, YEAR_S

O = REDDIT.origin


def test_json_with_bad_record_cap(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(
        '{"body": "hi", "author": "a", "created_utc": 1, "subreddit": "s"}\n'
        "not json at all\n"
        '{"body": "yo", "author": "b", "created_utc": 2, "subreddit": "t"}\n'
    )
    df = read_json(spark, str(p), "comment", max_bad_records=1)
    assert sorted(r.author for r in df.collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        read_json(spark, str(p), "comment", max_bad_records=0)


BAD_JSON = (
    '{"body": "hi", "author": "a", "created_utc": 1, "subreddit": "s"}\n'
    '{"body": "no", "author": "x", "created_utc": "soon", "subreddit": "s"}\n'
    '{"body": "no", "author": "y", "created_utc": [1], "subreddit": "t"}\n'
)
BAD_CSV = "body,author,created_utc,subreddit\nhi,a,1,s\nno,x,soon,s\nno,y,later,t\n"


@pytest.mark.parametrize("read,text,kw", [(read_json, BAD_JSON, {}), (read_csv, BAD_CSV, {}), (read_csv, BAD_CSV, {"multiline": True})])
def test_type_errors_in_any_column_count_whatever_is_read(spark, tmp_path, read, text, kw):
    p = tmp_path / "c.txt"
    p.write_text(text)
    for cap in (0, 1):
        with pytest.raises(ValueError):
            read(spark, str(p), "comment", max_bad_records=cap, **kw)
    df = read(spark, str(p), "comment", max_bad_records=2, **kw)
    assert df.count() == 1 and df.select("body").count() == 1
    assert [r.body for r in df.select("body").collect()] == ["hi"]
    assert [tuple(r) for r in df.collect()] == [("hi", "a", 1, "s")]


@pytest.mark.parametrize("multiline", [False, True])
def test_short_and_long_csv_rows(spark, tmp_path, multiline):
    p = tmp_path / "c.csv"
    p.write_text('body,author,created_utc,subreddit\nhi,a,1,s\n"sh,ort",b\n"lo,ng",c,3,t,more,"and, more"\nbad,d,x\n')
    names = lambda **kw: sorted(r.author for r in read_csv(spark, str(p), "comment", multiline=multiline, **kw).collect())
    for cap in (0, 2):
        with pytest.raises(ValueError):
            names(max_bad_records=cap)
    assert names(max_bad_records=3) == ["a"]
    assert names(max_bad_records=2, allow_jagged_rows=True) == ["a", "b"]
    assert names(max_bad_records=2, ignore_unknown_values=True) == ["a", "c"]
    got = read_csv(spark, str(p), "comment", multiline=multiline, max_bad_records=1, allow_jagged_rows=True, ignore_unknown_values=True)
    assert sorted(map(tuple, got.collect())) == [("hi", "a", 1, "s"), ("lo,ng", "c", 3, "t"), ("sh,ort", "b", None, None)]


def test_unknown_json_fields(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"author": "a", "extra": 1}\n{"author": "b", "created_utc": 2}\n')
    assert read_json(spark, str(p), "comment", max_bad_records=0).count() == 2
    got = read_json(spark, str(p), "comment", max_bad_records=1, ignore_unknown_values=False)
    assert [r.author for r in got.collect()] == ["b"]


def test_csv_leading_rows_of_every_file_are_skipped(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("a note\nbody,author,created_utc,subreddit\n" + "".join(f"t,u{k},{i},s\n" for i in range(200)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        df = read_csv(spark, str(tmp_path), "comment", skip_rows=2, max_bad_records=0)
        assert df.count() == 600 and df.where("created_utc is null").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_files_are_split_over_tasks(spark, tmp_path):
    (tmp_path / "c.csv").write_text("body,author,created_utc,subreddit\n" + "x,a,1,s\n" * 20_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = read_csv(spark, str(tmp_path), "comment")
        assert df.select(F.spark_partition_id()).distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_quoted_newlines_and_jagged_rows(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text('body;author;created_utc;subreddit\n"two\nlines";a;1;s\nshort;b\n')
    df = read_csv(spark, str(p), "comment", sep=";", multiline=True)
    got = sorted((r.author, r.body, r.created_utc) for r in df.collect())
    assert got == [("a", "two\nlines", 1), ("b", "short", None)]


def test_shards_are_pruned_by_year(spark, tmp_path):
    rows = [("x", "a", O + k * YEAR_S + 5, "s") for k in range(4)]
    path = str(tmp_path / "shards")
    write_shards(spark.createDataFrame(rows, RAW_COMMENT_SCHEMA), path, REDDIT)
    df = read_shards(spark, path, [2008, 2009])
    assert sorted(r.created_utc for r in df.collect()) == [O + YEAR_S + 5, O + 2 * YEAR_S + 5]
    plan = df._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "year" in partition_filters


def test_write_dispositions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(3)
    save(df, path, "empty")
    with pytest.raises(Exception):
        save(df, path, "empty")
    save(df, path, "append")
    assert spark.read.parquet(path).count() == 6
    save(df, path, "truncate")
    assert spark.read.parquet(path).count() == 3


def test_fetch_helpers(spark):
    df = spark.range(25).select(F.col("id").alias("v"))
    assert list(fetch_columns(df.orderBy("v"))["v"]) == list(range(25))
    pages = list(fetch_pages(df, page_size=10))
    assert [len(p) for p in pages] == [10, 10, 5]


def test_save_and_open_base_tables(spark, tmp_path):
    from cohortlens.plans.analyses import ANALYSES
    from cohortlens.plans.community import Community
    from tests.conftest import SMALL, rows

    c = Community.from_fixture(spark, SMALL, materialize=True)
    root = str(tmp_path / "community")
    c.save_tables(root)
    with pytest.raises(Exception):
        c.save_tables(root)  # 'empty' disposition refuses to overwrite
    reopened = Community.open_tables(spark, root, c.spec)
    for name in ("q01_cumulative_growth", "q02_active_monthly", "q06_posts_per_user_cohort_utime", "q11_ratio_cohort_time"):
        assert rows(ANALYSES[name](reopened)) == rows(ANALYSES[name](c)), name


def test_command_line_run_and_reuse(spark, tmp_path):
    from cohortlens.__main__ import main
    from cohortlens.plans.analyses import ANALYSES
    from cohortlens.plans.community import Community
    from cohortlens.sources import fixture
    from tests.conftest import SMALL, rows

    comments, submissions = fixture.community(spark, SMALL)
    comments.write.json(str(tmp_path / "comments"))
    submissions.write.json(str(tmp_path / "submissions"))
    only = "q05_posts_per_user_cohort_time,q13_ratio_survival,heavy_authors"
    args = ["--comments", str(tmp_path / "comments"), "--submissions", str(tmp_path / "submissions"),
            "--spec", "fixture", "--only", only, "--out", str(tmp_path / "out"), "--tables", str(tmp_path / "tables")]
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "false")
    assert main(args) == 0
    assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"  # tuned where it runs
    want = ANALYSES["q05_posts_per_user_cohort_time"](Community.from_fixture(spark, SMALL))
    assert rows(spark.read.parquet(str(tmp_path / "out" / "q05_posts_per_user_cohort_time"))) == rows(want)
    assert spark.read.parquet(str(tmp_path / "out" / "heavy_authors")).count() == 20
    again = ["--reuse", "--tables", str(tmp_path / "tables"), "--spec", "fixture", "--only", only + ",active_approx",
             "--out", str(tmp_path / "out2")]
    assert main(again) == 0
    assert spark.read.parquet(str(tmp_path / "out2" / "active_approx")).count() > 0
    assert rows(spark.read.parquet(str(tmp_path / "out2" / "q13_ratio_survival"))) == rows(
        spark.read.parquet(str(tmp_path / "out" / "q13_ratio_survival"))
    )
