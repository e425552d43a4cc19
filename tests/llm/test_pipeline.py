import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from brute import dedup_text, simhash
from test_mixing import targets
from test_tokens import check_packed

COLS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]


def test_stages_are_the_five_in_order():
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mixing", "packing"]


def test_every_stage_against_brute_force(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    outs = {}
    for name, stage in P.STAGES:
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        docs = outs[name] = spark.read.parquet(f"{tmp_path}/{name}")
    whole = rows_of(spark.read.parquet(f"{path}/documents.parquet"))
    kept = rows_of(outs["language_id"])
    assert sorted(kept) == sorted(whole)  # all of these are in a known language
    lines = rows_of(outs["line_dedup"])
    want = [(r[0], t, *r[2:]) for r, t in zip(kept, dedup_text([r[:2] for r in kept])) if t.strip() or not r[1].strip()]
    assert sorted(lines) == sorted(want)
    assert outs["line_dedup"].where(F.length("text") != F.col("n_chars")).count() == 0
    fps = {r[0]: simhash(r[1]) for r in lines}
    groups = {}
    for i in sorted(fps):
        near = {g for g, members in groups.items() if any((fps[i] ^ fps[m]).bit_count() <= 4 for m in members)}
        groups[min(near | {i})] = [i] + [m for g in near for m in groups.pop(g)]
    single = rows_of(outs["simhash_dedup"])
    assert sorted(r[0] for r in single) == sorted(min(m) for m in groups.values())
    assert set(single) <= set(lines)
    mixed = rows_of(outs["mixing"])
    size, target = targets(single)
    words = {}
    for r in mixed:
        assert r in single
        words[r[3]] = words.get(r[3], 0) + len(r[1].split())
    assert all(abs(words.get(s, 0) - target[s]) <= max(len(r[1].split()) for r in single if r[3] == s) for s in size)
    check_packed(outs["packing"].collect(), [r[:2] for r in mixed])
    got = sorted(map(tuple, P.run(spark, path).select("doc_id", "piece", "ids_crc32").collect()))
    assert got == sorted(map(tuple, outs["packing"].select("doc_id", "piece", "ids_crc32").collect()))


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stages_take_odd_rows_and_empty_tables(spark, make_docs, odd, extra_columns, name, stage):
    docs = make_docs(odd, extra_columns)
    out = stage(spark, docs, "")
    if name != "packing":
        assert out.columns == docs.columns
    n = out.count()
    assert n > 0
    if name == "language_id":
        assert not [r for r in out.collect() if r["text"] is None or not any(c.isalpha() for c in r["text"])]
        assert n == sum(1 for r in odd if r[1] is not None and any(c.isalpha() for c in r[1]))
    assert stage(spark, docs.limit(0), "").count() == 0
