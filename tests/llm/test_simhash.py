import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import simhash, simhash_components
from cohortlens.llm import simhash as S
from cohortlens.llm.components import connected_components, local_roots
from cohortlens.llm.queries import op2_simhash


def result(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=str)


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    for t in ["", None, "a", "A b", "Ab c D", "a b c d", "a b c d e É Ü x", "x\x0by z\x85q \xa0 w", " ".join(rng.choice("abcde") for _ in range(500))]:
        assert S.fingerprint(t) == simhash(t)


def test_fingerprint_of_a_text_longer_than_one_piece():
    text = " ".join(f"w{i % 701}" for i in range(70_000))
    assert S.fingerprint(text) == simhash(text)


def test_odd_rows(spark, odd, docs_dir, extra_columns):
    got = result(op2_simhash(spark, docs_dir(odd, extra_columns)))
    assert got == sorted(simhash_components([r[:2] for r in odd]), key=str)


def test_empty_table(spark, docs_dir):
    df = op2_simhash(spark, docs_dir([]))
    assert df.columns == ["doc_id", "fingerprint", "component_id"] and df.count() == 0


def test_sf_table_against_all_pairs(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op2_simhash(spark, path)) == sorted(simhash_components(docs), key=str)


@pytest.mark.parametrize("max_rows,max_variants", [(50_000, 1 << 22), (20, 3000)])
def test_links_connect_all_pairs_within_four_bits(spark, monkeypatch, max_rows, max_variants):
    """Random fingerprints and clusters around some of them; small limits force longer prefixes."""
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = []
    for f in fps[:12]:
        for _ in range(15):
            flip = np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(1, 7), replace=False).astype(np.uint64))
            near.append(f ^ flip)
    fps = np.unique(np.concatenate([fps, np.array(near, dtype=np.uint64), np.zeros(1, np.uint64)]))
    d = np.bitwise_count(fps[:, None] ^ fps[None])
    a, b = np.nonzero(d <= 4)
    want = fps[local_roots(len(fps), a, b)]
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    links = S.fingerprint_links(df, 4, max_rows=max_rows)
    pos = {int(f): k for k, f in enumerate(fps.view(np.int64))}
    got = [(pos[r["a"]], pos[r["b"]]) for r in links.collect()]
    assert all(d[x, y] <= 12 for x, y in got)
    x, y = (np.array(v, dtype=np.int64) for v in zip(*got))
    assert (fps[local_roots(len(fps), x, y)] == want).all()


def test_cutting_inside_a_task_keeps_all_links(monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(0b1011), base ^ (np.uint64(1) << np.uint64(50))]))
    left = np.full(len(fps), 2)

    def roots():
        got = list(S._colliding(fps, left, 64, 2))
        return local_roots(len(fps), np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]))

    whole = roots()
    monkeypatch.setattr(S, "MAX_VARIANTS", 5000)
    assert (roots() == whole).all()


def test_odd_distance_is_refused(spark):
    with pytest.raises(ValueError):
        S.fingerprint_links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7), (5, None)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in (200, 201, 202)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_of_each_group(spark, odd, make_docs, extra_columns):
    docs = make_docs(odd, extra_columns)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    want = {}
    for (i, _, c), r in zip(simhash_components([r[:2] for r in odd]), odd):
        want.setdefault((simhash_group(odd, r)), []).append((i is None, i, r[1]))
    assert kept.count() == len(want)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(min(v, key=lambda x: (x[0], x[1] or 0))[1]) for v in want.values())
    assert S.keep_one(docs.where(F.lit(False))).count() == 0


def simhash_group(rows, row):
    """A stable name of the row's group: the smallest fingerprint linked to it."""
    fps = sorted({simhash(r[1]) for r in rows})
    group = {simhash(row[1])}
    while True:
        more = {f for f in fps if any((f ^ g).bit_count() <= 4 for g in group)}
        if more == group:
            return min(group)
        group = more | group
