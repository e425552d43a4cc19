import random

import pytest
from pyspark.sql import functions as F

from brute import dedup_text
from cohortlens.llm import line_dedup as D
from cohortlens.llm.queries import op5_line_dedup


def got(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def want(docs):
    return sorted(((i, t) for (i, *_), t in zip(docs, dedup_text([r[:2] for r in docs]))), key=str)


def test_whole_table(spark):
    path = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op5_line_dedup(spark, path)) == want(docs)


def test_odd_rows(spark, odd, docs_dir, extra_columns):
    assert got(op5_line_dedup(spark, docs_dir(odd, extra_columns))) == want(odd)
    assert op5_line_dedup(spark, docs_dir([])).count() == 0


def line(rng, n):
    return " ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) + str(rng.randrange(1000)) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_random_documents(spark, docs_dir, seed):
    """Shared passages of several short lines, moved, repeated and interrupted, between headers
    that all documents have."""
    rng = random.Random(seed)
    passages = [[line(rng, rng.randrange(1, 25)) for _ in range(rng.randrange(1, 7))] for _ in range(12)]
    docs = []
    for i in range(40):
        lines = ["the same header", "Of."]
        for _ in range(rng.randrange(1, 6)):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = line(rng, 8)
            lines += p if rng.random() < 0.7 else [line(rng, rng.randrange(1, 40)), " " + p[0] + "\t", ""]
        docs.append((i, "\n".join(lines), "en", "a"))
    assert got(op5_line_dedup(spark, docs_dir(docs))) == want(docs)


def test_passage_in_many_documents_stays_in_the_first_only(spark, docs_dir):
    passage = " ".join(f"word{k}" for k in range(55))
    docs = [(i, f"own line {i}\n{passage}\nend {i}", "en", "a") for i in range(60)]
    rows = op5_line_dedup(spark, docs_dir(docs)).orderBy("doc_id").collect()
    assert passage in rows[0]["text"] and rows[0]["n_deleted"] == 0 and not rows[0]["duplicate_of"]
    assert all(r["text"] == f"own line {r['doc_id']}\nend {r['doc_id']}" and r["duplicate_of"] == [0] for r in rows[1:])


def test_exact_copies_are_removed_whole(spark, docs_dir):
    text = "\n".join(" ".join(f"w{k}x{j}" for j in range(9)) for k in range(6))
    rows = op5_line_dedup(spark, docs_dir([(3, text, "en", "a"), (8, text, "en", "a"), (9, text + "\n", "en", "a")])).orderBy("doc_id").collect()
    assert [(r["removed"], r["text"]) for r in rows] == [(False, text), (True, ""), (True, "")]


def test_short_shared_lines_stay(spark, docs_dir):
    docs = [(i, f"cookie notice and some more words\ntext number {i}\nOf.", "en", "a") for i in range(20)]
    assert all(r["n_deleted"] == 0 for r in op5_line_dedup(spark, docs_dir(docs)).collect())


def test_windows_are_the_smallest_runs():
    lines = ["a b", "", "c d e", "f", "g h i j"]
    assert D.windows(lines, 4) == [(0, 2), (2, 3), (3, 4), (4, 4)]
    assert D.windows([], 4) == [] and D.windows([""], 1) == [] and D.windows(["a"], 2) == []


def test_chain_is_the_longest_ascending_one():
    assert D.chain([]) == []
    places = [3, 1, 4, 1, 5, 9, 2, 6]
    got_places = [places[k] for k in D.chain(places)]
    assert len(got_places) == 4 and got_places == sorted(set(got_places))


def test_merged_blocks_are_disjoint():
    assert D.merged([(2, 3), (0, 1)]) == [(0, 1), (2, 3)]
    assert D.merged([(0, 1), (1, 2), (7, 8)]) == [(0, 2), (7, 8)]


def test_removed_flag_needs_words(spark, make_docs):
    df = D.dedup_lines(make_docs([(1, "", "en", "a"), (2, None, "en", "a"), (3, "\n", "en", "a")]))
    assert df.where(F.col("__empty")).count() == 0
