"""Steps whose cost must not grow faster than the tables: rows built once, partitions of one size, small dumps."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from cohortlens.operators.clean import clean_comments, clean_submissions
from cohortlens.plans import blocks, clustered
from cohortlens.session import ADAPTIVE, shuffle_partitions_for
from cohortlens.sources import fixture

from .conftest import SMALL, rows


def test_name_rules_work_out_the_author_once(spark):
    for clean, raw in ((clean_submissions, fixture.raw_submissions), (clean_comments, fixture.raw_comments)):
        plan = clean(raw(spark, SMALL))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("hour(o_orderdate") == 1


def test_a_value_worked_out_once_keeps_every_row(spark):
    df = spark.createDataFrame([(1,), (None,), (1,)], "x long")
    assert rows(fixture.once(df, "y", F.col("x") + 1)) == [(None, None), (1, 2), (1, 2)]


def test_partitions_grow_with_the_tables():
    assert shuffle_partitions_for(5 * 2**30, cores=12) >= 320
    assert int(ADAPTIVE["spark.sql.adaptive.advisoryPartitionSizeInBytes"].rstrip("b")) <= 16 * 2**20


def test_dumps_are_compressed(small_community, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    for query in (blocks.json_ingest, blocks.json_bad_records, blocks.stream_ingest, blocks.csv_ingest):
        assert query(small_community).count()
    for dump in ("comments-json", "submissions-json", "comments-bad-json", "submissions-dump", "comments-csv"):
        parts = list((tmp_path / dump).glob("part-*"))
        assert parts and all(p.suffix == ".gz" for p in parts)


def test_buckets_grow_with_the_posts(spark):
    posts = lambda *n: SimpleNamespace(users=spark.createDataFrame([(x,) for x in n], "n_posts long"))
    assert clustered.buckets_for(posts(), least=8) == clustered.buckets_for(posts(10, None), least=8) == 8
    assert clustered.buckets_for(posts(20_000_000, 1), least=8) == 21
